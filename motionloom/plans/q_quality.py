"""Queries: recording and stream quality, filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import rounded as r
from ..operators import clean as C
from ..operators import quality as Q
from ..operators.ordered import exact_percentile, one_row, spread_join
from .registry import query
from .views import AXES, SCORES, features, imu6, recordings, segments1, stream1, stream_rows, table

DEV = ["device"]


@query("recording_summary", sql="""
, d AS (SELECT event_id, user_id AS device, epoch_us(ts) / 1e6 AS host, event_id % 50 AS chip, event_type AS unit, value FROM events UNION ALL
 SELECT event_id + 100000000, user_id, epoch_us(ts) / 1e6, event_id % 50, event_type, value FROM events WHERE event_type = 'view'),
a AS (SELECT device, count(*) AS rows, count(DISTINCT (host, chip, unit, value)) AS da, count(DISTINCT host) AS dh, count(DISTINCT chip) AS dc, count(DISTINCT unit) AS du,
 arg_min(host, event_id) AS h0, arg_max(host, event_id) AS h1 FROM d GROUP BY 1)
SELECT device, rows, round(CASE WHEN h1 - h0 > 0 THEN h1 - h0 ELSE rows - 1 END, 6) + 0.0 AS duration_s,
 round((rows - 1) / CASE WHEN h1 - h0 > 0 THEN h1 - h0 ELSE rows - 1 END, 8) + 0.0 AS sample_rate_hz, 4 AS columns, 'q0' AS missing_core_columns,
 rows - da AS full_duplicate_rows, round((rows - da) / rows, 6) + 0.0 AS full_duplicate_ratio, round((rows - dh) / rows, 6) + 0.0 AS host_timestamp_duplicate_ratio,
 round((rows - dc) / rows, 6) + 0.0 AS onboard_timestamp_duplicate_ratio, du AS device_count, round(h0, 6) + 0.0 AS start_s, round(h0 % 86400, 6) + 0.0 AS start_second_of_day FROM a""")
def q_summary(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("device"), "event_id", (F.unix_micros("ts") / F.lit(1e6)).alias("host"), (F.col("event_id") % 50).alias("chip"),
        F.col("event_type").alias("unit"), "value")
    d = e.unionByName(e.filter("unit = 'view'").withColumn("event_id", F.col("event_id") + 100000000))
    s = Q.recording_summary(d, DEV, "event_id", "host", "chip", "unit", ["host", "chip", "value", "q0"])
    digits = {"duration_s": 6, "sample_rate_hz": 8, "start_s": 6, "start_second_of_day": 6, "full_duplicate_ratio": 6,
              "host_timestamp_duplicate_ratio": 6, "onboard_timestamp_duplicate_ratio": 6}
    return s.withColumns({c: r(F.col(c), n) for c, n in digits.items()})


@query("channel_profile", uses="stream1", sql="""
, l AS (SELECT device, 'x' AS channel, idx, x FROM stream1 UNION ALL SELECT device, 'y', idx, round(x / 40) FROM stream1),
p AS (SELECT *, lag(x) OVER (PARTITION BY device, channel ORDER BY idx) AS prev FROM l),
s AS (SELECT *, abs(x - prev) AS step, coalesce(x = 0, false) AS z, coalesce(x = prev, false) AS k FROM p),
m AS (SELECT device, channel, median(x) AS med, median(step) AS jmed FROM s GROUP BY 1, 2),
a AS (SELECT device, channel, any_value(med) AS med, any_value(jmed) AS jmed, median(abs(x - med)) AS mad, median(abs(step - jmed)) AS jmad FROM s JOIN m USING (device, channel) GROUP BY 1, 2),
zr AS (SELECT device, channel, max(n) AS n FROM (SELECT device, channel, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY device, channel, z ORDER BY idx) AS g FROM s) q WHERE z GROUP BY device, channel, g) w GROUP BY 1, 2),
kr AS (SELECT device, channel, max(n) AS n FROM (SELECT device, channel, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY device, channel, k ORDER BY idx) AS g FROM s) q WHERE k GROUP BY device, channel, g) w GROUP BY 1, 2)
SELECT s.device, s.channel, count(x) AS count, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0 END), 6) + 0.0 AS missing_ratio, round(avg(CAST(z AS INT)), 6) + 0.0 AS zero_ratio,
 coalesce(any_value(zr.n), 0) AS longest_zero_run, coalesce(any_value(kr.n) + 1, 0) AS longest_constant_run, count(DISTINCT x) AS unique_values, round(avg(x), 6) + 0.0 AS mean,
 round(stddev_samp(x), 5) + 0.0 AS std, min(x) AS min, max(x) AS max, round(avg(CASE WHEN mad > 1e-12 AND 0.67448975 * abs(x - med) / mad > 8 THEN 1.0 ELSE 0 END), 6) + 0.0 AS robust_outlier_ratio,
 round(avg(CASE WHEN jmad > 1e-12 AND 0.67448975 * abs(step - jmed) / jmad > 10 THEN 1.0 ELSE 0 END), 6) + 0.0 AS jump_ratio,
 round(avg(CASE WHEN abs(x) > 300 THEN 1.0 ELSE 0 END), 6) + 0.0 AS physical_limit_ratio
FROM s JOIN a USING (device, channel) LEFT JOIN zr ON zr.device = s.device AND zr.channel = s.channel LEFT JOIN kr ON kr.device = s.device AND kr.channel = s.channel GROUP BY 1, 2""")
def q_profile(spark, sf):
    s = stream1(spark, sf).select("device", "idx", "x", F.round(F.col("x") / 40).alias("y"))
    p = Q.channel_profile(C.long_channels(s, ["device", "idx"], ["x", "y"]), ["device", "channel"], "idx", "x", F.lit(300.0))
    six = ["missing_ratio", "zero_ratio", "mean", "robust_outlier_ratio", "jump_ratio", "physical_limit_ratio"]
    return p.withColumns({**{c: r(F.col(c)) for c in six}, "std": r(F.col("std"), 5)})


@query("overview_by_dim", uses="recs", sql="""
SELECT activity, count(DISTINCT capture_group) AS sessions, count(*) AS samples, round(median(duration_s), 6) + 0.0 AS duration_s_median,
 round(median(sample_rate_hz), 6) + 0.0 AS sample_rate_hz_median, round(median(full_duplicate_ratio), 6) + 0.0 AS full_duplicate_ratio_median FROM recs GROUP BY 1""")
def q_overview(spark, sf):
    o = Q.overview_by_dim(recordings(spark, sf), "activity")
    return o.withColumns({c: r(F.col(c)) for c in o.columns if c.endswith("_median")})


@query("quality_totals", uses="recs", sql="""
SELECT count(*) AS files, CAST(sum(rows) AS BIGINT) AS total_rows, round(median(sample_rate_hz), 6) + 0.0 AS rate_median, round(min(sample_rate_hz), 6) + 0.0 AS rate_min, round(max(sample_rate_hz), 6) + 0.0 AS rate_max,
 CAST(sum(round(rows * full_duplicate_ratio)) AS BIGINT) AS duplicates FROM recs""")
def q_totals(spark, sf):
    d = recordings(spark, sf)
    med = exact_percentile(d, [], "sample_rate_hz", {"m": 0.5})
    a = d.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("total_rows"), F.min("sample_rate_hz").alias("lo"), F.max("sample_rate_hz").alias("hi"),
              F.sum(F.round(F.col("rows") * F.col("full_duplicate_ratio"))).cast("long").alias("duplicates"))
    return one_row(a, med).select("files", "total_rows", r(F.col("m")).alias("rate_median"), r(F.col("lo")).alias("rate_min"), r(F.col("hi")).alias("rate_max"), "duplicates")


PAIR_SQL = """, p AS (SELECT capture_group, device_id, count(*) AS n, count_if(source_format = 'csv') AS nc, count_if(source_format = 'txt') AS nt,
 max(start_second_of_day) FILTER (source_format = 'csv') AS c1, max(start_second_of_day) FILTER (source_format = 'txt') AS t1, max(duration_s) FILTER (source_format = 'csv') AS c2, max(duration_s) FILTER (source_format = 'txt') AS t2,
 max(sample_rate_hz) FILTER (source_format = 'csv') AS c3, max(sample_rate_hz) FILTER (source_format = 'txt') AS t3, max(rows) FILTER (source_format = 'csv') AS c4, max(rows) FILTER (source_format = 'txt') AS t4 FROM recs GROUP BY 1, 2),
f AS (SELECT capture_group, device_id, abs(c1 - t1) AS a, abs(c2 - t2) AS b, abs(c3 - t3) AS c, abs(c4 - t4) AS d FROM p WHERE n = 2 AND nc = 1 AND nt = 1)
"""


@query("format_pair_join", uses="recs", sql=PAIR_SQL + """
SELECT capture_group, device_id, round(a, 6) + 0.0 AS start_offset_s, round(b, 6) + 0.0 AS duration_abs_diff_s, round(c, 6) + 0.0 AS sample_rate_abs_diff_hz, d AS row_count_abs_diff FROM f""")
def q_pairs(spark, sf):
    p = Q.format_pairs(recordings(spark, sf), ["capture_group", "device_id"])
    return p.withColumns({c: r(F.col(c)) for c in ("start_offset_s", "duration_abs_diff_s", "sample_rate_abs_diff_hz")})


@query("equivalent_exports_test", uses="recs", sql=PAIR_SQL + """
SELECT round(median(a), 6) + 0.0 AS start_offset_s, round(median(b), 6) + 0.0 AS duration_abs_diff_s, round(median(c), 6) + 0.0 AS sample_rate_abs_diff_hz,
 median(a) < 0.1 AND median(b) < 0.2 AND median(c) < 0.1 AS equivalent FROM f""")
def q_equivalent(spark, sf):
    e = Q.equivalent_exports(Q.format_pairs(recordings(spark, sf), ["capture_group", "device_id"]))
    return e.withColumns({c: r(F.col(c)) for c in e.columns if c != "equivalent"})


ACT_SQL = "CASE recording % 23 WHEN 0 THEN '未标注动作' WHEN 1 THEN '擦耳机' WHEN 2 THEN '深蹲提前终止' WHEN 3 THEN '走路+跑步' ELSE activity END"
FLAG_SQL = f""", a AS (SELECT *, {ACT_SQL} AS act, greatest(50, round_even(sample_rate_hz / 50, 0) * 50) AS nominal FROM recs),
f AS (SELECT *, concat_ws(';', CASE WHEN trim(missing_core_columns) <> '' THEN 'missing_core_columns' END, CASE WHEN NOT orientation_valid THEN 'orientation_invalid' END,
 CASE WHEN duration_s < 20 THEN 'short_recording' END, CASE WHEN abs(sample_rate_hz - nominal) / nominal > 0.15 THEN 'sampling_rate_irregular' END,
 CASE WHEN contains(act, '未标注') THEN 'unlabelled_action' END, CASE WHEN contains(act, '擦耳机') THEN 'earphone_contact_artifact' END,
 CASE WHEN contains(act, '提前终止') THEN 'protocol_truncated' END, CASE WHEN contains(act, '+') THEN 'mixed_action' END) AS flags FROM a),
u AS (SELECT *, NOT regexp_matches(flags, 'missing_core_columns|short_recording|unlabelled_action|earphone_contact_artifact|protocol_truncated|mixed_action') AS motion FROM f)
"""


def flagged(spark, sf):
    c = F.col
    d = recordings(spark, sf).withColumn("activity", F.expr(ACT_SQL))
    d = d.withColumn("fl", Q.quality_flags(c("missing_core_columns"), c("orientation_valid"), c("duration_s"), c("sample_rate_hz"), c("activity")))
    motion, posture = Q.usable(c("fl"), c("orientation_valid"))
    return d.select("*", F.concat_ws(";", "fl").alias("quality_flags"), motion.alias("motion_binary_usable"), posture.alias("posture_usable"),
                    Q.rate_mode(c("sample_rate_hz")).alias("sampling_rate_mode_hz"))


@query("quality_flags", uses="recs", sql=FLAG_SQL + """
SELECT recording, flags AS quality_flags, motion AS motion_binary_usable, motion AND orientation_valid AS posture_usable,
 greatest(1, round_even(sample_rate_hz / 50, 0)) * 50.0 AS sampling_rate_mode_hz FROM u""")
def q_flags(spark, sf):
    return flagged(spark, sf).select("recording", "quality_flags", "motion_binary_usable", "posture_usable", "sampling_rate_mode_hz")


@query("flag_counts", uses="recs", sql=FLAG_SQL + """
SELECT flag, count(*) AS n FROM (SELECT UNNEST(string_split(flags, ';')) AS flag FROM u) x WHERE flag <> '' GROUP BY 1
UNION ALL SELECT '_motion_usable', count_if(motion) FROM u UNION ALL SELECT '_posture_usable', count_if(motion AND orientation_valid) FROM u""")
def q_flag_counts(spark, sf):
    marks = F.concat(F.col("fl"), F.array_compact(F.array(F.when(F.col("motion_binary_usable"), "_motion_usable"), F.when(F.col("posture_usable"), "_posture_usable"))))
    return flagged(spark, sf).select(F.explode(marks).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("audit_left_join", sql="""
, s AS (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS repaired, count(*) AS log_rows FROM lineitem GROUP BY 1)
SELECT o_orderkey AS recording, c_mktsegment AS split, repaired, log_rows FROM orders
 LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 2 = o_orderkey % 2 LEFT JOIN s ON l_orderkey = o_orderkey""")
def q_audit(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recording"), F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 2).alias("device_id"))
    split = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_nationkey") % 2).alias("device_id"), F.col("c_mktsegment").alias("split"))
    log = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recording"), F.col("l_linenumber").alias("repaired"))
    return audit_left_join(q, split, log, ["source_id", "device_id"], "recording", ["repaired"]).select("recording", "split", "repaired", "log_rows")


def audit_left_join(quality, split, log, on, recording, counts):
    """quality with its split and the summed cleaning counts; sums are taken before the join."""
    sums = log.groupBy(recording).agg(*[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("log_rows"))
    return spread_join(quality, split, on, large=True).join(sums.hint("merge"), recording, "left")


@query("signal_quality", uses="imu6", sql="""
, c AS (SELECT device, floor(idx / 200) AS win, UNNEST([CASE WHEN idx % 97 = 0 THEN NULL ELSE ax * 16.6 END, ay, az, gx * 10, gy, gz]) AS v, UNNEST([15.9, 15.9, 15.9, 1990, 1990, 1990]) AS lim FROM imu6),
q AS (SELECT device, win, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS m, avg(CASE WHEN abs(v) >= lim THEN 1.0 ELSE 0 END) AS c FROM c GROUP BY 1, 2)
SELECT device, CAST(win AS BIGINT) AS win, round(m, 6) + 0.0 AS missing_ratio, round(c, 6) + 0.0 AS clipped_ratio, CASE WHEN m > 0.02 OR c > 0.02 THEN 'poor' WHEN m > 0 OR c > 0.002 THEN 'fair' ELSE 'good' END AS state FROM q""")
def q_signal(spark, sf):
    d = imu6(spark, sf).withColumns({"ax": F.when(F.col("idx") % 97 != 0, F.col("ax") * 16.6), "gx": F.col("gx") * 10, "win": F.floor(F.col("idx") / 200)})
    s = Q.signal_quality(d, ["device", "win"], AXES[:3], AXES[3:])
    return s.withColumns({"missing_ratio": r(F.col("missing_ratio")), "clipped_ratio": r(F.col("clipped_ratio"))})


@query("orientation_valid", uses="imu6", sql="""
SELECT device, count(DISTINCT a1) > 2 AND count(DISTINCT a2) > 2 AND max(abs(q)) > 0 AS orientation_valid FROM
 (SELECT device, CASE WHEN device % 5 = 0 THEN sign(roll - 3) ELSE roll END AS a1, pitch AS a2, CASE WHEN device % 7 = 0 THEN 0 ELSE gx END AS q FROM imu6) z GROUP BY 1""")
def q_orientation(spark, sf):
    d = F.col("device")
    s = imu6(spark, sf).select("device", F.when(d % 5 == 0, F.when(F.col("roll") > 3, 1.0).when(F.col("roll") < 3, -1.0).otherwise(0.0)).otherwise(F.col("roll")).alias("a1"),
                               F.col("pitch").alias("a2"), F.when(d % 7 == 0, 0.0).otherwise(F.col("gx")).alias("q"))
    return Q.orientation_valid(s, DEV, ["a1", "a2"], ["q"])


STREAM_SQL = """, i AS (SELECT device, idx, idx * 20000000 + CASE WHEN gx > 190 THEN 90000000 WHEN gy = 150 THEN -40000000 ELSE 0 END AS ns, (idx + CASE WHEN gz = 60 THEN 1 ELSE 0 END) % 65536 AS seq,
  CASE WHEN idx % 211 = 5 THEN NULL ELSE ax END AS ax, gx FROM imu6),
l AS (SELECT *, ns - lag(ns) OVER w AS dt, ((seq - lag(seq) OVER w) % 65536 + 65536) % 65536 AS ds FROM i WINDOW w AS (PARTITION BY device ORDER BY idx)),
b AS (SELECT device, count(*) AS row_count, (arg_max(ns, idx) - arg_min(ns, idx)) / 1e9 AS dur, count_if(dt <= 0) AS reorder_count, CAST(sum(greatest(ds - 1, 0)) AS BIGINT) AS sequence_gap_count,
 count_if(ds = 0) AS sequence_duplicate_count, (avg(CASE WHEN abs(ax) >= 0.995 * 0.96 THEN 1.0 ELSE 0 END) + avg(CASE WHEN abs(gx) >= 0.995 * 200 THEN 1.0 ELSE 0 END)) / 2 AS clipped, avg(CASE WHEN ax IS NULL THEN 1.0 ELSE 0 END) / 2 AS bad,
 CASE WHEN device % 4 = 0 THEN 60.0 ELSE 50.0 END AS cfg FROM l GROUP BY device),
o AS (SELECT *, CASE WHEN dur > 0 THEN (row_count - 1) / dur ELSE 0 END AS rate FROM b),
g AS (SELECT device, count_if(dt > greatest(1e8, 3e9 / greatest(rate, 1e-9))) AS long_gap_count FROM l JOIN o USING (device) GROUP BY 1),
q AS (SELECT o.*, long_gap_count, concat_ws(';', CASE WHEN reorder_count > 0 THEN 'timestamp_not_strictly_increasing' END, CASE WHEN NOT (rate BETWEEN 0.95 * cfg AND 1.05 * cfg) THEN 'sample_rate_outside_5_percent' END,
 CASE WHEN long_gap_count > 0 THEN 'long_timestamp_gap' END, CASE WHEN sequence_gap_count > 0 THEN 'sequence_gap' END, CASE WHEN sequence_duplicate_count > 0 THEN 'sequence_duplicate_or_reorder' END,
 CASE WHEN bad > 0 THEN 'non_finite_sensor_value' END, CASE WHEN clipped > 0.002 THEN 'sensor_saturation' END) AS issues FROM o JOIN g USING (device))
"""


def strict_stream(spark, sf, axes=("ax", "gx"), sound=None):
    """imu6 as a strict stream: ns clock with jitter, sequence ids, missing and clipped values; without these faults where ``sound``."""
    c = F.col
    bad = F.lit(True) if sound is None else ~sound
    return imu6(spark, sf).select(
        "device", "idx", (c("idx") * 20000000 + F.when(bad & (c("gx") > 190), 90000000).when(bad & (c("gy") == 150), -40000000).otherwise(0)).alias("ns"),
        ((c("idx") + F.when(bad & (c("gz") == 60), 1).otherwise(0)) % 65536).alias("seq"), F.when(~bad | (c("idx") % 211 != 5), c("ax")).alias("ax"), *[a for a in axes if a != "ax"])


def stream_report(spark, sf):
    return Q.stream_quality(strict_stream(spark, sf), DEV, "idx", "ns", "seq", ["ax"], ["gx"], F.when(F.col("device") % 4 == 0, 60.0).otherwise(50.0), F.lit(0.96), F.lit(200.0))


@query("stream_quality", uses="imu6", sql=STREAM_SQL + """
SELECT device, row_count, round(dur, 6) + 0.0 AS duration_seconds, cfg AS configured_rate_hz, round(rate, 6) + 0.0 AS observed_rate_hz, reorder_count, sequence_gap_count, sequence_duplicate_count,
 long_gap_count, round(clipped, 6) + 0.0 AS clipped_ratio, round(bad, 6) + 0.0 AS non_finite_ratio, issues FROM q""")
def q_stream(spark, sf):
    s = stream_report(spark, sf)
    return s.withColumns({**{c: r(F.col(c)) for c in ("duration_seconds", "observed_rate_hz", "clipped_ratio", "non_finite_ratio")}, "issues": F.concat_ws(";", "issues")})


@query("prefer_source_format", uses="recs", sql="""
, b AS (SELECT capture_group, device_id, min(CASE source_format WHEN 'csv' THEN 0 WHEN 'txt' THEN 1 ELSE 2 END) AS p FROM recs GROUP BY 1, 2)
SELECT recording, recs.source_format FROM recs JOIN b USING (capture_group, device_id) WHERE p = CASE source_format WHEN 'csv' THEN 0 WHEN 'txt' THEN 1 ELSE 2 END""")
def q_prefer(spark, sf):
    return Q.prefer_source_format(recordings(spark, sf), ["capture_group", "device_id"], "source_format", {"csv": 0, "txt": 1}).select("recording", "source_format")


GATE_SQL = """, rec AS (SELECT user_id AS device, max(value) AS duration_s, CASE WHEN user_id % 9 = 0 THEN false ELSE true END AS label_trainable,
  CASE user_id % 4 WHEN 0 THEN 'legacy_reviewed' WHEN 1 THEN 'rejected' ELSE 'gold' END AS evidence_tier FROM events GROUP BY user_id),
iv AS (SELECT segment_id, device, duration_s / 4 - 2 AS s, duration_s / 4 - 2 + segment_id % 12 AS e, activity <> 'error' AS wt, CASE segment_id % 6 WHEN 0 THEN 'calibration' WHEN 1 THEN 'transition' ELSE 'active' END AS phase,
  CASE WHEN segment_id % 5 > 0 THEN 'motion' END AS ms, CASE WHEN segment_id % 8 = 0 THEN 'removed' ELSE 'valid' END AS ws FROM segments1),
el AS (SELECT iv.device, segment_id, greatest(0, s) AS start_s, least(duration_s, e) AS end_s FROM iv JOIN rec USING (device) WHERE duration_s <= 180 AND wt AND phase = 'active' AND ms = 'motion' AND ws = 'valid'
  AND least(duration_s, e) - greatest(0, s) >= 4 AND evidence_tier = 'gold')
"""


@query("trainability_gate", uses="segments1", sql=GATE_SQL + """
, n AS (SELECT device, count(*) AS intervals FROM el GROUP BY 1)
SELECT 'recording' AS part, device, coalesce(intervals, 0) AS n, CASE WHEN duration_s > 180 THEN 'session_weak_over_180_seconds' WHEN NOT label_trainable THEN 'label_marked_not_window_trainable'
 WHEN evidence_tier = 'legacy_reviewed' THEN 'legacy_evidence_requires_explicit_experimental_flag' WHEN intervals IS NULL THEN 'missing_or_unreviewed_dual_label' ELSE '' END AS note FROM rec LEFT JOIN n USING (device)
UNION ALL SELECT 'interval', device, segment_id, CAST(CAST(round(start_s * 100) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(round(end_s * 100) AS BIGINT) AS VARCHAR) FROM el""")
def q_gate(spark, sf):
    c = F.col
    u = c("device")
    rec = table(spark, sf, "events").groupBy(F.col("user_id").alias("device")).agg(F.max("value").alias("duration_s")).withColumns({
        "label_trainable": u % 9 != 0, "evidence_tier": F.when(u % 4 == 0, "legacy_reviewed").when(u % 4 == 1, "rejected").otherwise("gold")})
    s = c("segment_id")
    iv = segments1(spark, sf).select(
        "device", "segment_id", (c("duration_s") / 4 - 2).alias("start_s"), (c("duration_s") / 4 - 2 + s % 12).alias("end_s"), (c("activity") != "error").alias("window_trainable"),
        F.when(s % 6 == 0, "calibration").when(s % 6 == 1, "transition").otherwise("active").alias("phase"), F.when(s % 5 > 0, "motion").alias("motion_state"),
        F.when(s % 8 == 0, "removed").otherwise("valid").alias("wear_state"),
        F.when(u % 4 == 0, "legacy_reviewed").when(u % 4 == 1, "rejected").otherwise("gold").alias("tier"))
    el, m = Q.trainability_gate(iv, rec, DEV)
    cs = lambda x: F.round(c(x) * 100).cast("long").cast("string")
    return m.select(F.lit("recording").alias("part"), "device", c("intervals").alias("n"), c("excluded_reason").alias("note")).unionByName(
        el.select(F.lit("interval").alias("part"), "device", c("segment_id").alias("n"), F.concat_ws("-", cs("start_s"), cs("end_s")).alias("note")))


@query("stable_pose_gate", uses="features", sql="""
SELECT vec_id, label FROM features WHERE abs(f0) * 60 <= 12 AND abs(f1) <= 0.08 AND CASE WHEN label = 0 THEN abs(f2) * 100 <= 12 ELSE abs(f2) * 100 >= 15 END""")
def q_pose(spark, sf):
    f = F.col
    kind = F.when(f("label") == 0, "normal").otherwise("other")
    return features(spark, sf).filter(Q.stable_pose(F.abs("f0") * 60, F.abs("f1"), F.abs("f2") * 100, kind)).select("vec_id", "label")


@query("confidence_fallback", uses="features", sql="""
, p AS (SELECT vec_id, s0 AS a, s1 AS b, s2 AS c, s3 AS d, s0 + s1 + s2 + s3 AS s FROM features),
g AS (SELECT *, greatest(a, b, c, d) / s AS top, CASE WHEN a = greatest(a,b,c,d) THEN 'run' WHEN b = greatest(a,b,c,d) THEN 'sitting' WHEN c = greatest(a,b,c,d) THEN 'squat' ELSE 'standing' END AS best, (a + c) / s AS motion FROM p)
SELECT vec_id, CASE WHEN top < 0.65 THEN CASE WHEN motion >= 0.5 THEN 'other_motion' ELSE 'other_non_motion' END ELSE best END AS action, round(motion, 6) + 0.0 AS motion_probability FROM g""")
def q_fallback(spark, sf):
    m = class_probabilities(features(spark, sf))
    action, motion = confidence_fallback(F.col("probabilities"), ["run", "squat"])
    return m.select("vec_id", action.alias("action"), r(motion).alias("motion_probability"))


def class_probabilities(f):
    """features rows with a map of class probabilities, the shape a model would give."""
    a = [F.col(s) for s in SCORES]
    total = a[0] + a[1] + a[2] + a[3]
    names = ["run", "sitting", "squat", "standing"]
    return f.withColumn("probabilities", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[x / total for x in a])))


def confidence_fallback(probabilities, motion_classes, threshold=0.65):
    """Best class, or the motion/non-motion remainder class when it is not sure; and the motion probability."""
    motion = F.least(F.lit(1.0), S.map_sum_subset(probabilities, motion_classes))
    best = S.map_argmax(probabilities)
    top = F.array_max(F.map_values(probabilities))
    return F.when(top < threshold, F.when(motion >= 0.5, "other_motion").otherwise("other_non_motion")).otherwise(best), motion


@query("top_k_metric", uses="stream1", sql="""
SELECT channel, round(avg(m), 6) + 0.0 AS missing_ratio FROM (SELECT device, channel, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0 END) AS m FROM stream1 GROUP BY 1, 2) z GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def q_topk(spark, sf):
    per = stream_rows(spark, sf).groupBy("device", "channel").agg(F.avg(F.col("x").isNull().cast("double")).alias("m"))
    return top_k(per.groupBy("channel").agg(r(F.avg("m")).alias("missing_ratio")), "missing_ratio", "channel", 3)


def top_k(df, metric, name, k):
    """Largest k by metric, name as tie-break (no full sort: TakeOrderedAndProject)."""
    return df.orderBy(F.col(metric).desc(), F.col(name)).limit(k)
