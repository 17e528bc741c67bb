"""Queries: joins, resampling, sets, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import rounded as r
from ..operators import joins as J
from ..operators import resample as R
from ..operators.clean import long_channels
from .q_quality import class_probabilities
from .q_scalar import NAME_SQL
from .registry import query
from .views import features, imu6, segments1, segments6_of, stream1, stream_rows, table
from ..session import staged

DEV = ["device"]
REVIEWED = [("深蹲0组", "squat", "active", True), ("深蹲1组", "squat", "active", True), ("深蹲2组", "squat", "active", True), ("自由行走", "free_walk", "active", True),
            ("坐姿", "sitting", "rest", True), ("佩戴取下", "removed_wear", "artifact", False)]
EXCLUDED = [("深蹲2组", "truncated protocol"), ("耳机掉落", "device fell")]
TERMS = [(0, "aux", "t0"), (1, "tion", "t1"), (2, "ein", "t2"), (3, "the", "t3"), (4, "ch", "t4"), (5, "a", "t5")]


def _values(rows):
    return ", ".join("(" + ", ".join("'" + str(v) + "'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in rows)


@query("taxonomy_exact_join", sql=f"""
, n AS (SELECT event_id, {NAME_SQL} AS name FROM events), v AS (SELECT * FROM (VALUES {_values(REVIEWED)}) q(raw, id, phase, ok)), x AS (SELECT * FROM (VALUES {_values(EXCLUDED)}) q(raw, reason))
SELECT event_id, CASE WHEN coalesce(ok, false) AND reason IS NULL THEN id END AS activity_id, CASE WHEN reason IS NOT NULL OR phase IS NULL THEN 'transition' ELSE phase END AS phase,
 coalesce(ok, false) AND reason IS NULL AS usable FROM n LEFT JOIN v ON v.raw = name LEFT JOIN x ON x.raw = name""")
def q_taxonomy(spark, sf):
    name = F.expr(NAME_SQL)
    d = table(spark, sf, "events").select("event_id", F.concat(F.lit(" "), F.substring(name, 1, 1), F.lit(" "), F.expr(f"substring({NAME_SQL}, 2)")).alias("name"))
    reviewed = spark.createDataFrame(REVIEWED, "raw_name string, activity_id string, phase string, trainable boolean")
    excluded = spark.createDataFrame(EXCLUDED, "raw_name string, reason string")
    return J.taxonomy_join(d, "name", reviewed, excluded).select("event_id", "activity_id", "phase", "usable")


@query("legacy_contains_join", sql=f"""
, t AS (SELECT * FROM (VALUES {_values(TERMS)}) q(ordinal, term, value))
SELECT doc_id, (SELECT arg_min(value, ordinal) FROM t WHERE contains(text, term)) AS value FROM documents""")
def q_contains(spark, sf):
    terms = spark.createDataFrame(TERMS, "ordinal int, term string, value string")
    return J.contains_first(table(spark, sf, "documents").select("doc_id", "text"), "text", terms).select("doc_id", "value")


@query("segment_interval_join", uses="imu6 segments6", sql="""
, s AS (SELECT device, segment_id, CAST(ceil(start_s * 50) AS BIGINT) AS lo, CAST(floor(end_s * 50) AS BIGINT) AS hi FROM segments6),
p AS (SELECT s.device, segment_id, idx - lo AS j, ax FROM imu6 i JOIN s ON s.device = i.device AND idx >= lo AND idx < hi),
w AS (SELECT device, segment_id, k, count(*) AS n, avg(ax) AS m FROM p JOIN (SELECT UNNEST(generate_series(0, 30)) AS k) g ON j >= k * 25 AND j < k * 25 + 50 GROUP BY 1, 2, 3)
SELECT device, segment_id, k AS win, round(m, 5) + 0.0 AS ax_mean FROM w WHERE n = 50""")
def q_interval(spark, sf):
    x = staged(imu6(spark, sf).select("device", "idx", "ax", "gx", "gz", "roll"), "imu6-seg")
    return segment_windows(x, segments6_of(x), 50.0, 50, 25).groupBy("device", "segment_id", "_wb", "win").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ax").alias("m")).filter("n = 50").select("device", "segment_id", "win", r(F.col("m"), 5).alias("ax_mean"))


#: Windows of a segment that are worked on together.
SEGMENT_WINDOWS = 1024


def segment_windows(samples, segments, fs, n, step):
    """Samples of each labelled segment, exploded to the windows numbered from the segment's start.

    Rows are dealt to (segment, ``_wb``: a block of its windows) before they are copied for the windows, so grouping by both and ``win`` shuffles nothing more.
    """
    s = segments.withColumns({"lo": F.ceil(F.col("start_s") * fs), "hi": F.floor(F.col("end_s") * fs)})
    p = J.interval_join(samples, s, ["device"], "idx", "lo", "hi", 4096.0).withColumn("_j", F.col("idx") - F.col("lo"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_j") - n + 1) / step)), F.floor(F.col("_j") / step)
    blocks = F.sequence(F.floor(first / SEGMENT_WINDOWS), F.floor(last / SEGMENT_WINDOWS))
    p = p.filter(first <= last).withColumn("_wb", F.explode(blocks)).repartition("device", "segment_id", "_wb")
    first, last = F.greatest(first, F.col("_wb") * SEGMENT_WINDOWS), F.least(last, F.col("_wb") * SEGMENT_WINDOWS + SEGMENT_WINDOWS - 1)
    return p.withColumn("win", F.explode(F.sequence(first, last)))


@query("segment_asof_assign", uses="imu6 segments6", sql="""
, s AS (SELECT device, segment_id, start_s, least(end_s, segment_id * 3 + 3) AS end_s, start_s = max(start_s) OVER (PARTITION BY device) AS last FROM segments6)
SELECT s.device, segment_id, min(idx) AS start_row, max(idx) AS end_row, count(idx) AS row_count FROM s LEFT JOIN imu6 i ON i.device = s.device AND t >= start_s AND (t < end_s OR last AND t = end_s) GROUP BY 1, 2""")
def q_asof(spark, sf):
    x = staged(imu6(spark, sf).select("device", "idx", "t", "gx", "gz", "roll"), "imu6-seg")
    s = segments6_of(x).withColumn("end_s", F.least(F.col("end_s"), F.col("segment_id") * 3.0 + 3.0))
    return J.segment_assign(x, s, DEV, "t", "idx", "segment_id", "start_s", "end_s", 60.0).select("device", "segment_id", "start_row", "end_row", "row_count")


@query("grid_interpolate", uses="stream1", sql="""
, q AS (SELECT device, row_id, epoch_us(ts) / 1e6 AS t, x FROM stream1),
k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS lt, last_value(x IGNORE NULLS) OVER a AS lv, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS rt, first_value(x IGNORE NULLS) OVER b AS rv
 FROM q WINDOW a AS (PARTITION BY device ORDER BY t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY device ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT device, row_id, round(coalesce(lv + (rv - lv) * (t - lt) / (rt - lt), lv, rv), 5) + 0.0 AS x FROM k WHERE x IS NULL""")
def q_grid(spark, sf):
    d = stream_rows(spark, sf).withColumn("t", F.unix_micros("ts") / F.lit(1e6))
    g = R.grid_interpolate(d.filter("x IS NOT NULL"), d.filter("x IS NULL"), DEV, "t", "x", F.floor(F.col("t") / 3600), "row_id")
    return g.withColumn("x", r(F.col("x"), 5))


@query("uniform_resample_dedup", uses="imu6", sql="""
, j AS (SELECT device, floor(idx / 3) * 0.06 + CASE WHEN idx % 3 = 2 THEN 0.03 ELSE 0 END AS t, ax, gx FROM imu6),
d AS (SELECT device, t, avg(ax) AS ax, avg(gx) AS gx FROM j GROUP BY 1, 2), e AS (SELECT device, max(t) AS dur FROM d GROUP BY 1),
l AS (SELECT *, lead(t) OVER w AS nt, lead(ax) OVER w AS nax, lead(gx) OVER w AS ngx FROM d WINDOW w AS (PARTITION BY device ORDER BY t)),
g AS (SELECT device, k, k / 40.0 AS gt FROM e, LATERAL (SELECT UNNEST(generate_series(0, CAST(round(dur * 40) AS BIGINT))) AS k) WHERE k / 40.0 <= dur + 1e-9)
SELECT g.device, k, round(CASE WHEN nt IS NULL THEN ax ELSE ax + (nax - ax) * (gt - t) / (nt - t) END, 5) + 0.0 AS ax, round(CASE WHEN nt IS NULL THEN gx ELSE gx + (ngx - gx) * (gt - t) / (nt - t) END, 5) + 0.0 AS gx
FROM g ASOF JOIN l ON g.device = l.device AND g.gt >= l.t""")
def q_resample(spark, sf):
    i = F.col("idx")
    d = imu6(spark, sf).select("device", (F.floor(i / 3) * 0.06 + F.when(i % 3 == 2, 0.03).otherwise(0.0)).alias("t"), "ax", "gx")
    return uniform_resample_dedup(d, DEV, "t", ["ax", "gx"], 40.0).select("device", "k", r(F.col("ax"), 5).alias("ax"), r(F.col("gx"), 5).alias("gx"))


def uniform_resample_dedup(d, key, t, channels, hz):
    """Duplicate timestamps are averaged, then the uniform grid up to the key's last time."""
    from ..operators.ordered import number_rows, spread_join

    one = R.average_duplicates(d, key, t, channels)
    n = number_rows(one, key, [t], F.floor(F.col(t) / 600))
    n = spread_join(n, one.groupBy(*key).agg(F.max(t).alias("_dur")), key)
    return R.uniform_resample(n, key, "idx", t, channels, hz, "_dur")


@query("dual_stream_pair", sql="""
, s AS (SELECT user_id // 2 AS trial, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, (epoch_us(min(ts)) % 900000) * 1000 AS ns FROM events GROUP BY user_id),
g AS (SELECT trial, count(*) AS streams, count(DISTINCT side) = 2 AS both_sides, (max(ns) - min(ns)) / 1e6 AS off FROM s GROUP BY 1)
SELECT trial, streams, both_sides AS pair_complete, CASE WHEN streams = 2 THEN round(off, 4) + 0.0 END AS offset_ms, coalesce(streams = 2 AND off > 100, false) AS note, streams <> 2 OR NOT both_sides OR off > 500 AS hard FROM g""")
def q_dual(spark, sf):
    u = F.col("user_id")
    s = table(spark, sf, "events").groupBy("user_id").agg((F.unix_micros(F.min("ts")) % 900000 * 1000).alias("ns"))
    s = s.select(F.floor(u / 2).alias("trial"), F.when(u % 2 == 0, "left").otherwise("right").alias("side"), "ns")
    d = J.dual_stream_pair(s, "trial", "side", "ns")
    return d.withColumn("offset_ms", r(F.col("offset_ms"), 4))


@query("baseline_join", uses="features", sql="""
, b AS (SELECT grp, subject, avg(f0) AS base FROM features WHERE label < 3 GROUP BY 1, 2)
SELECT vec_id, base IS NOT NULL AS included, CASE WHEN base IS NULL THEN 'missing_normal_seated_baseline' ELSE '' END AS excluded_reason, round(f0 - base, 6) + 0.0 AS relative FROM features LEFT JOIN b USING (grp, subject)""")
def q_baseline(spark, sf):
    f = features(spark, sf)
    b = f.filter("label < 3").groupBy("grp", "subject").agg(F.avg("f0").alias("base"))
    return J.baseline_join(f, b, ["grp", "subject"], "base").select("vec_id", "included", "excluded_reason", r(F.col("f0") - F.col("base")).alias("relative"))


@query("missing_orphan_labels", sql="""
, r AS (SELECT DISTINCT o_custkey AS id FROM orders), l AS (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier)
SELECT 'missing_label' AS kind, id FROM r WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT DISTINCT 'orphan_label', id FROM l WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT 'duplicate_label', id FROM l GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'inventory', count(*) FROM (SELECT id FROM r UNION SELECT id FROM l) u""")
def q_reconcile(spark, sf):
    rec = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    lab = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("id")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    return J.reconcile(rec, lab, "id")


@query("capture_override_join", sql="""
SELECT event_id, CASE WHEN c_custkey IS NOT NULL THEN lower(c_mktsegment) ELSE event_type END AS activity, CASE WHEN c_custkey IS NOT NULL THEN 'reviewed' END AS decision FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 = 0""")
def q_override(spark, sf):
    cap = table(spark, sf, "events").select("event_id", F.concat(F.lit("/day\\dev\\"), F.col("user_id").cast("string"), F.lit("/")).alias("rel"), F.col("event_type").alias("activity"))
    ov = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("day/dev/"), F.col("c_custkey").cast("string")).alias("path"),
                                                                   F.lower("c_mktsegment").alias("activity"), F.lit("reviewed").alias("decision"), F.lit("seg").alias("reason"))
    return J.override_join(cap, ov, "rel").select("event_id", "activity", "decision")


@query("inherit_split", sql="""
, s AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'test' WHEN 'MACHINERY' THEN 'validation' ELSE 'train' END AS split FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, coalesce(split, 'unassigned') AS split, coalesce(split, '') IN ('validation', 'test') AS formal_evaluation FROM orders LEFT JOIN s ON c_custkey = o_custkey""")
def q_inherit(spark, sf):
    sp = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("subject"), F.when(F.col("c_mktsegment") == "BUILDING", "test")
                                                                     .when(F.col("c_mktsegment") == "MACHINERY", "validation").otherwise("train").alias("split"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"))
    return J.inherit_split(o, sp, "subject").select("o_orderkey", "split", "formal_evaluation")


@query("pairwise_cross", uses="features", sql="""
, c AS (SELECT label, count(*) AS n FROM features GROUP BY 1) SELECT a.label AS label_a, b.label AS label_b, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.label < b.label""")
def q_pairs(spark, sf):
    return J.class_pairs(features(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", ["n"])


@query("union_all_events", sql="""
SELECT event_id AS id, event_type AS anomaly_type, value AS original_value, NULL AS action_taken FROM events UNION ALL SELECT o_orderkey, o_orderstatus, NULL, o_orderpriority FROM orders""")
def q_union(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("anomaly_type"), F.col("value").alias("original_value"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("anomaly_type"), F.col("o_orderpriority").alias("action_taken"))
    return a.unionByName(b, allowMissingColumns=True)


@query("device_set_match", sql="""
, l AS (SELECT DISTINCT o_custkey AS trial, o_orderkey % 3 AS dev FROM orders), m AS (SELECT DISTINCT c_custkey AS trial, UNNEST([0, 1, 2]) AS dev FROM customer)
SELECT trial, bool_and(a AND b) AS match FROM (SELECT coalesce(l.trial, m.trial) AS trial, l.trial IS NOT NULL AS a, m.trial IS NOT NULL AS b FROM l FULL JOIN m ON l.trial = m.trial AND l.dev = m.dev) z GROUP BY 1""")
def q_devices(spark, sf):
    l = table(spark, sf, "orders").select(F.col("o_custkey").alias("trial"), (F.col("o_orderkey") % 3).alias("dev"))
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("trial"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("dev"))
    return J.device_set_match(l, m, "trial", "dev")


PROB_SQL = """, p AS (SELECT vec_id, s0 AS a, s1 AS b, s2 AS c, s3 AS d, s0 + s1 + s2 + s3 AS s FROM features)"""


@query("map_argmax", uses="features", sql=PROB_SQL + """
SELECT vec_id, CASE greatest(a,b,c,d) WHEN a THEN 'run' WHEN b THEN 'sitting' WHEN c THEN 'squat' ELSE 'standing' END AS best FROM p""")
def q_argmax(spark, sf):
    return class_probabilities(features(spark, sf)).select("vec_id", S.map_argmax(F.col("probabilities")).alias("best"))


@query("map_sum_subset", uses="features", sql=PROB_SQL + " SELECT vec_id, round((a + c) / s, 6) + 0.0 AS motion FROM p")
def q_subset(spark, sf):
    return class_probabilities(features(spark, sf)).select("vec_id", r(S.map_sum_subset(F.col("probabilities"), ["run", "squat"])).alias("motion"))


@query("json_struct_roundtrip", sql="""
SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, '{"k":' || CAST(props->>'k' AS INTEGER) || ',"type":"' || event_type || '"}' AS payload FROM events""")
def q_json(spark, sf):
    s = F.from_json("props", "k int")
    return table(spark, sf, "events").select("event_id", s["k"].alias("k"), F.to_json(s.withField("type", F.col("event_type"))).alias("payload"))


@query("segments_explode", sql="""
SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings""")
def q_explode(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query("lcs_length")
def q_lcs(spark, sf):
    signs = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: F.when(x > 0.1, "u").when(x < -0.1, "d").otherwise("z"))
    return table(spark, sf, "embeddings").select("vec_id", S.lcs_length(signs(1, 32), signs(33, 32)).alias("lcs"))


@query("duplicate_ids", sql="""
, s AS (SELECT vec_id, UNNEST(embedding) AS v FROM embeddings), b AS (SELECT vec_id, CAST(floor(v * 20) AS BIGINT) AS id FROM s) SELECT vec_id, id, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) > 1""")
def q_dup(spark, sf):
    ids = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("v")).select("vec_id", F.floor(F.col("v").cast("double") * 20).alias("id"))
    return ids.groupBy("vec_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("argbest_tiebreak", sql="""
, s AS (SELECT user_id, event_id, floor(value / 50) AS score FROM events) SELECT user_id, arg_min(event_id, (-score, event_id)) AS best, CAST(max(score) AS BIGINT) AS score FROM s GROUP BY 1""")
def q_best(spark, sf):
    s = F.floor(F.col("value") / 50)
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(s, -F.col("event_id"))).alias("best"), F.max(s).alias("score"))
