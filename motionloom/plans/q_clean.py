"""Queries: row-window cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded as r
from ..operators import clean as C
from ..operators import ordered as O
from ..session import staged
from .registry import query
from .views import AXES, imu6, stream1, stream_rows, table

LIMITS = {"ax": 0.95, "ay": 16.0, "az": 16.0, "gx": 199.0, "gy": 2000.0, "gz": 2000.0}
DEV = ["device"]


@query("dedupe_keep_first", sql="""
, d AS (SELECT event_id AS source_row, user_id, ts, event_type, value FROM events UNION ALL
 SELECT event_id + 100000000, user_id, ts, event_type, value FROM events WHERE event_type = 'view')
SELECT min(source_row) AS source_row, user_id, epoch_us(ts) AS us, event_type, value FROM d GROUP BY user_id, ts, event_type, value""")
def q_dedupe(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("source_row"), "user_id", F.unix_micros("ts").alias("us"), "event_type", "value")
    again = e.filter("event_type = 'view'").withColumn("source_row", F.col("source_row") + 100000000)
    return C.dedupe_keep_first(e.unionByName(again), ["user_id", "us", "event_type", "value"], "source_row")


ZERO_SQL = """, n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS rr FROM (SELECT *, CASE WHEN x = 0 THEN 0 ELSE x / 100 + 2.5 END AS v FROM stream1) z
 WINDOW w AS (PARTITION BY device ORDER BY idx)),
b AS (SELECT *, coalesce(v = 0 AND sign(l) = sign(rr) AND abs(l - rr) <= greatest(0.2 * abs((l + rr) / 2), 0.01) AND abs((l + rr) / 2) > 0.02, false) AS bad FROM n)"""


def zeroed(spark, sf):
    return stream1(spark, sf).withColumn("v", F.when(F.col("x") == 0, 0.0).otherwise(F.col("x") / 100 + 2.5))


@query("isolated_zero", uses="stream1", sql=ZERO_SQL + " SELECT device, row_id, bad FROM b")
def q_zero(spark, sf):
    w = O.block_window(DEV)
    d = O.with_halo(zeroed(spark, sf), "idx", 1, 1).withColumn("bad", C.isolated_zero(F.col("v"), w))
    return O.keep_core(d).select("device", "row_id", "bad")


@query("hampel_spike", uses="imu6", sql="""
, s AS (SELECT device, idx, CASE WHEN idx % 40 = 7 THEN ax * 40 ELSE (t - floor(t)) + ax / 1000 END AS x FROM imu6),
m AS (SELECT *, CASE WHEN count(x) OVER w >= 3 THEN median(x) OVER w END AS med FROM s WINDOW w AS (PARTITION BY device ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
d AS (SELECT *, abs(x - med) AS dev FROM m),
k AS (SELECT *, CASE WHEN count(dev) OVER w >= 3 THEN median(dev) OVER w END AS mad, lag(x) OVER o AS l, lead(x) OVER o AS rr FROM d
 WINDOW w AS (PARTITION BY device ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), o AS (PARTITION BY device ORDER BY idx))
SELECT device, idx, coalesce(dev > 8 * 1.4826 * mad AND 8 * 1.4826 * mad > 1e-12 AND abs(l - rr) <= greatest(0.25 * dev, 1e-9), false) AS spike FROM k""")
def q_hampel(spark, sf):
    width = C.hampel_width(60.0)  # 9 rows
    t, i = F.col("t"), F.col("idx")
    s = imu6(spark, sf).select("device", "idx", F.when(i % 40 == 7, F.col("ax") * 40).otherwise(t - F.floor(t) + F.col("ax") / 1000).alias("x"))
    w = O.block_window(DEV)
    d = O.with_halo(s, "idx", width + 1, width + 1)
    d = d.withColumn("dev", F.abs(F.col("x") - C.rolling_median(F.col("x"), w, width)))
    d = d.withColumn("mad", C.rolling_median(F.col("dev"), w, width))
    d = d.withColumn("spike", C.hampel_spike(F.col("x"), F.col("dev"), F.col("mad"), w))
    return O.keep_core(d).select("device", "idx", "spike")



FILL_SQL = """, g AS (SELECT device, idx, row_id, CASE WHEN (row_id * 37) % 100 < 55 THEN x END AS v FROM stream1),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING) AS li,
  min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY device ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM g),
j AS (SELECT k.*, a.v AS lv, b.v AS rv FROM k LEFT JOIN g a ON a.device = k.device AND a.idx = k.li LEFT JOIN g b ON b.device = k.device AND b.idx = k.ri),
f AS (SELECT *, coalesce(v, CASE WHEN li IS NOT NULL AND ri IS NOT NULL THEN lv + (rv - lv) * (idx - li) / (ri - li) END, lv, rv) AS full_v FROM j)"""


def gapped(spark, sf):
    return stream1(spark, sf).select("device", "idx", "row_id", F.when((F.col("row_id") * 37) % 100 < 55, F.col("x")).alias("v"))


@query("fill_short_gaps", uses="stream1", sql=FILL_SQL + """
SELECT device, row_id, round(CASE WHEN v IS NOT NULL THEN v WHEN idx - li <= 1 OR ri - idx <= 1 THEN full_v END, 6) + 0.0 AS filled FROM f""")
def q_fill(spark, sf):
    d = C.fill_short_gaps(gapped(spark, sf), DEV, "idx", ["v"], 1)
    return d.select("device", "row_id", r(F.col("v")).alias("filled"))


@query("impute_linear_all", uses="stream1", sql=FILL_SQL + " SELECT device, row_id, round(coalesce(full_v, 0), 6) + 0.0 AS filled FROM f")
def q_impute(spark, sf):
    d = C.impute_linear_all(gapped(spark, sf), DEV, "idx", ["v"])
    return d.select("device", "row_id", r(F.col("v")).alias("filled"))


@query("smooth_centred", uses="imu6", sql="""
SELECT device, idx, round(avg(ax) OVER (PARTITION BY device ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 5) + 0.0 AS ax,
 round(avg(gx) OVER (PARTITION BY device ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 5) + 0.0 AS gx FROM imu6""")
def q_smooth(spark, sf):
    d = C.smooth_centred(imu6(spark, sf), DEV, "idx", ["ax", "gx"], 6)
    return d.select("device", "idx", r(F.col("ax"), 5).alias("ax"), r(F.col("gx"), 5).alias("gx"))


CLEAN_SQL = """, s AS (SELECT device, idx, ax AS raw FROM imu6),
z AS (SELECT *, CASE WHEN NOT coalesce(raw = 0 AND sign(l) = sign(rr) AND abs(l - rr) <= greatest(0.2 * abs((l + rr) / 2), 0.01) AND abs((l + rr) / 2) > 0.02, false) THEN raw END AS y
  FROM (SELECT *, lag(raw) OVER w AS l, lead(raw) OVER w AS rr FROM s WINDOW w AS (PARTITION BY device ORDER BY idx)) q),
m AS (SELECT *, abs(y - CASE WHEN count(y) OVER w >= 3 THEN median(y) OVER w END) AS dev, lag(y) OVER o AS yl, lead(y) OVER o AS yr FROM z
  WINDOW w AS (PARTITION BY device ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), o AS (PARTITION BY device ORDER BY idx)),
k AS (SELECT *, 8 * 1.4826 * CASE WHEN count(dev) OVER w >= 3 THEN median(dev) OVER w END AS lim FROM m
  WINDOW w AS (PARTITION BY device ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
p AS (SELECT device, idx, raw, raw IS NOT NULL AND y IS NULL AS zero, coalesce(dev > lim AND lim > 1e-12 AND abs(yl - yr) <= greatest(0.25 * dev, 1e-9), false) AS spike, y FROM k),
g AS (SELECT *, CASE WHEN NOT spike THEN y END AS v FROM p),
h AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING) AS li,
  min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY device ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM g),
j AS (SELECT h.*, a.v AS lv, b.v AS rv FROM h LEFT JOIN g a ON a.device = h.device AND a.idx = h.li LEFT JOIN g b ON b.device = h.device AND b.idx = h.ri),
f AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN idx - li <= 15 OR ri - idx <= 15 THEN coalesce(lv + (rv - lv) * (idx - li) / (ri - li), lv, rv) END AS filled FROM j),
c AS (SELECT *, avg(filled) OVER (PARTITION BY device ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS clean FROM f)
"""


def cleaned_ax(spark, sf):
    return C.clean_channels(imu6(spark, sf).select("device", "idx", "ax"), DEV, "idx", ["ax"], 62.0)


@query("clean_channel", uses="imu6", sql=CLEAN_SQL + " SELECT device, idx, zero, spike, round(clean, 5) + 0.0 AS clean FROM c")
def q_clean(spark, sf):
    return cleaned_ax(spark, sf).select("device", "idx", F.col("ax_zero").alias("zero"), F.col("ax_spike").alias("spike"), r(F.col("ax"), 5).alias("clean"))


JUMP_SQL = """, t AS (SELECT *, abs(raw - lag(raw) OVER (PARTITION BY device ORDER BY idx)) AS step FROM c),
jm AS (SELECT device, median(step) AS med FROM t GROUP BY 1),
ja AS (SELECT device, med, median(abs(step - med)) AS mad FROM t JOIN jm USING (device) GROUP BY 1, 2),
w AS (SELECT c2.*, coalesce(CASE WHEN mad > 1e-12 THEN 0.67448975 * abs(step - med) / mad > 10 END, false) AS jump, coalesce(abs(raw) > 0.95, false) AS lim
  FROM t c2 JOIN ja USING (device))
"""


def cleaned_with_jumps(spark, sf):
    base = staged(imu6(spark, sf).select("device", "idx", "ax"), "imu6-ax")
    c = C.clean_channels(base, DEV, "idx", ["ax"], 62.0)
    return C.robust_jump(c, DEV, "idx", "ax_raw", "ax_jump", basis=base.withColumnRenamed("ax", "ax_raw"))


FLAGS_SQL = f""", s AS (SELECT device, idx, UNNEST({list(LIMITS)}) AS channel, UNNEST([{", ".join(LIMITS)}]) AS raw, UNNEST([{", ".join(f"CAST({v} AS DOUBLE)" for v in LIMITS.values())}]) AS top FROM imu6),
z AS (SELECT *, CASE WHEN NOT coalesce(raw = 0 AND sign(l) = sign(rr) AND abs(l - rr) <= greatest(0.2 * abs((l + rr) / 2), 0.01) AND abs((l + rr) / 2) > 0.02, false) THEN raw END AS y
  FROM (SELECT *, lag(raw) OVER w AS l, lead(raw) OVER w AS rr FROM s WINDOW w AS (PARTITION BY device, channel ORDER BY idx)) q),
m AS (SELECT *, abs(y - CASE WHEN count(y) OVER w >= 3 THEN median(y) OVER w END) AS dev, lag(y) OVER o AS yl, lead(y) OVER o AS yr FROM z
  WINDOW w AS (PARTITION BY device, channel ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), o AS (PARTITION BY device, channel ORDER BY idx)),
k AS (SELECT *, 8 * 1.4826 * CASE WHEN count(dev) OVER w >= 3 THEN median(dev) OVER w END AS lim FROM m
  WINDOW w AS (PARTITION BY device, channel ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
p AS (SELECT device, idx, channel, raw, top, raw IS NOT NULL AND y IS NULL AS zero, coalesce(dev > lim AND lim > 1e-12 AND abs(yl - yr) <= greatest(0.25 * dev, 1e-9), false) AS spike FROM k),
t AS (SELECT *, abs(raw - lag(raw) OVER (PARTITION BY device, channel ORDER BY idx)) AS step FROM p),
jm AS (SELECT device, channel, median(step) AS med FROM t GROUP BY 1, 2),
ja AS (SELECT device, channel, med, median(abs(step - med)) AS mad FROM t JOIN jm USING (device, channel) GROUP BY 1, 2, 3),
w AS (SELECT t.*, coalesce(CASE WHEN mad > 1e-12 THEN 0.67448975 * abs(step - med) / mad > 10 END, false) AS jump, coalesce(abs(raw) > top, false) AS lim
  FROM t JOIN ja USING (device, channel))
"""


@query("row_anomaly_flags", uses="imu6", sql=FLAGS_SQL + """
SELECT device, idx, bool_or(zero OR spike) AS row_repaired, bool_or(zero OR spike OR raw IS NULL OR jump OR lim) AS row_anomaly FROM w GROUP BY 1, 2""")
def q_flags(spark, sf):
    base = staged(imu6(spark, sf).select("device", "idx", *AXES), "imu6-axes")
    c = C.clean_channels(base, DEV, "idx", AXES, 62.0)
    d = C.robust_jumps(c, DEV, "idx", {f"{a}_raw": f"{a}_jump" for a in AXES}, basis=base.withColumnsRenamed({a: f"{a}_raw" for a in AXES}))
    return C.row_flags(d, AXES, LIMITS).select("device", "idx", "row_repaired", "row_anomaly")


@query("anomaly_events", uses="imu6", sql=CLEAN_SQL + JUMP_SQL + """
, e AS (SELECT device, idx AS source_row, raw, UNNEST(['missing_input', 'isolated_zero', 'spike', 'jump_candidate', 'physical_limit_candidate']) AS anomaly_type,
 UNNEST([raw IS NULL, zero, spike, jump, lim]) AS hit, UNNEST(['short_gap_interpolated_if_possible', 'interpolated', 'interpolated', 'flag_only', 'flag_only']) AS action_taken FROM w)
SELECT device, source_row, round(source_row / 50.0, 4) + 0.0 AS analysis_time_s, 'ax' AS channel, anomaly_type, round(raw, 6) + 0.0 AS original_value, action_taken FROM e WHERE hit""")
def q_events(spark, sf):
    return anomaly_events(cleaned_with_jumps(spark, sf), "ax", 0.95)


def anomaly_events(d, c, limit):
    """Long table of one channel's anomalies."""
    kinds = [("missing_input", F.col(f"{c}_raw").isNull(), "short_gap_interpolated_if_possible"), ("isolated_zero", F.col(f"{c}_zero"), "interpolated"),
             ("spike", F.col(f"{c}_spike"), "interpolated"), ("jump_candidate", F.col(f"{c}_jump"), "flag_only"),
             ("physical_limit_candidate", C.over_limit(F.col(f"{c}_raw"), limit), "flag_only")]
    hits = F.array_compact(F.array(*[F.when(m, F.struct(F.lit(k).alias("anomaly_type"), F.lit(a).alias("action_taken"))) for k, m, a in kinds]))
    return d.withColumn("_h", F.explode(hits)).select(
        "device", F.col("idx").alias("source_row"), r(F.col("idx") / F.lit(50.0), 4).alias("analysis_time_s"), F.lit(c).alias("channel"),
        "_h.anomaly_type", r(F.col(f"{c}_raw")).alias("original_value"), "_h.action_taken")


def cleaning_counts(d, c, limit):
    n = lambda m: F.sum(m.cast("long"))
    return [n(F.col(f"{c}_raw").isNull()).alias("missing_input"), n(F.col(f"{c}_zero")).alias("isolated_zero_replaced"), n(F.col(f"{c}_spike")).alias("spike_replaced"),
            n(F.col(f"{c}_jump")).alias("jump_candidate"), n(F.col(f"{c}_gap")).alias("missing_after_detection"),
            n(F.col(c).isNull()).alias("missing_after_cleaning"), n(C.over_limit(F.col(f"{c}_raw"), limit)).alias("physical_limit_candidate")]


COUNT_SQL = """CAST(sum(CAST(raw IS NULL AS INT)) AS BIGINT) AS missing_input, CAST(sum(CAST(zero AS INT)) AS BIGINT) AS isolated_zero_replaced,
 CAST(sum(CAST(spike AS INT)) AS BIGINT) AS spike_replaced, CAST(sum(CAST(jump AS INT)) AS BIGINT) AS jump_candidate, CAST(sum(CAST(v IS NULL AS INT)) AS BIGINT) AS missing_after_detection,
 CAST(sum(CAST(clean IS NULL AS INT)) AS BIGINT) AS missing_after_cleaning, CAST(sum(CAST(lim AS INT)) AS BIGINT) AS physical_limit_candidate"""


@query("cleaning_log", uses="imu6", sql=CLEAN_SQL + JUMP_SQL + f"SELECT device, 'ax' AS channel, {COUNT_SQL} FROM w GROUP BY 1")
def q_log(spark, sf):
    return cleaned_with_jumps(spark, sf).groupBy("device", F.lit("ax").alias("channel")).agg(*cleaning_counts(None, "ax", 0.95))


@query("cleaning_totals", uses="imu6", sql=CLEAN_SQL + JUMP_SQL + f"""SELECT device, channel, {COUNT_SQL} FROM (SELECT *, 'ax' AS channel FROM w) x
GROUP BY ROLLUP (device, channel)""")
def q_totals(spark, sf):
    return cleaned_with_jumps(spark, sf).withColumn("channel", F.lit("ax")).rollup("device", "channel").agg(*cleaning_counts(None, "ax", 0.95))


@query("longest_run", uses="stream1", sql="""
, f AS (SELECT device, idx, x IS NULL OR x < 80 AS low, coalesce(channel = lag(channel) OVER w, false) AS same FROM stream1 WINDOW w AS (PARTITION BY device ORDER BY idx)),
a AS (SELECT device, count(*) AS n FROM (SELECT device, low, idx - row_number() OVER (PARTITION BY device, low ORDER BY idx) AS g FROM f) z WHERE low GROUP BY device, g),
b AS (SELECT device, count(*) AS n FROM (SELECT device, same, idx - row_number() OVER (PARTITION BY device, same ORDER BY idx) AS g FROM f) z WHERE same GROUP BY device, g)
SELECT d.device, coalesce((SELECT max(n) FROM a WHERE a.device = d.device), 0) AS longest_low, coalesce((SELECT max(n) + 1 FROM b WHERE b.device = d.device), 0) AS longest_constant
FROM (SELECT DISTINCT device FROM f) d""")
def q_run(spark, sf):
    d = O.neighbours(stream1(spark, sf), DEV, "idx", {"prev": "channel"})
    runs = C.longest_runs(d, DEV, "idx", {"longest_low": F.col("x").isNull() | (F.col("x") < 80), "longest_constant": F.col("channel") == F.col("prev")})
    return runs.withColumn("longest_constant", F.when(F.col("longest_constant") > 0, F.col("longest_constant") + 1).otherwise(0))


@query("robust_outlier", uses="stream1", sql="""
, m AS (SELECT device, median(x) AS med FROM stream1 GROUP BY 1), a AS (SELECT device, med, median(abs(x - med)) AS mad FROM stream1 JOIN m USING (device) GROUP BY 1, 2)
SELECT device, row_id, coalesce(CASE WHEN mad > 1e-12 THEN 0.67448975 * abs(x - med) / mad > 8 END, false) AS outlier FROM stream1 JOIN a USING (device)""")
def q_outlier(spark, sf):
    return C.robust_outlier(stream_rows(spark, sf), DEV, "x").select("device", "row_id", "outlier")


@query("robust_jump", uses="stream1", sql="""
, s AS (SELECT device, row_id, abs(x - lag(x) OVER (PARTITION BY device ORDER BY idx)) AS x FROM stream1),
m AS (SELECT device, median(x) AS med FROM s GROUP BY 1), a AS (SELECT device, med, median(abs(x - med)) AS mad FROM s JOIN m USING (device) GROUP BY 1, 2)
SELECT device, row_id, coalesce(CASE WHEN mad > 1e-12 THEN 0.67448975 * abs(x - med) / mad > 10 END, false) AS jump FROM s JOIN a USING (device)""")
def q_jump(spark, sf):
    return C.robust_jump(stream1(spark, sf), DEV, "idx", "x").select("device", "row_id", "jump")


@query("physical_limit_flag", uses="imu6", sql="""
SELECT device, idx, abs(ax * 20) > 16 OR abs(ay * 20) > 16 OR abs(az * 20) > 16 AS acc_limit, abs(gx * 11) > 2000 OR abs(gy * 11) > 2000 OR abs(gz * 11) > 2000 AS gyro_limit FROM imu6""")
def q_limit(spark, sf):
    hit = lambda cols, k, lim: C.over_limit(F.greatest(*[F.abs(F.col(c) * k) for c in cols]), lim)
    return imu6(spark, sf).select("device", "idx", hit(AXES[:3], 20, 16.0).alias("acc_limit"), hit(AXES[3:], 11, 2000.0).alias("gyro_limit"))
