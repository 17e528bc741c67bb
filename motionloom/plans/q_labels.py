"""Queries: label governance, timelines and trial audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded as r
from ..functions.taxonomy import posture_by_name
from ..operators import joins as J
from ..operators import labels as L
from ..operators import timeaxis as ta
from ..session import staged
from .q_quality import STREAM_SQL, stream_report
from .q_scalar import ACTIVITY_IDS, IDS_SQL, NAME_SQL
from .registry import query
from .views import segments1, table

DOC_SQL = f""", s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, (l_linenumber - 1) * 20 + l_quantity / 10 - 0.5 AS start_s,
 (l_linenumber - 1) * 20 + l_quantity / 10 - 0.5 + l_discount * 300 AS end_s, CASE WHEN l_partkey % 31 = 0 THEN 'mystery' ELSE {IDS_SQL}[l_partkey % 13 + 1] END AS activity_id,
 CASE l_partkey % 4 WHEN 0 THEN 'motion' WHEN 1 THEN 'non_motion' WHEN 2 THEN NULL ELSE CASE WHEN l_suppkey % 5 = 0 THEN 'weird' ELSE 'motion' END END AS motion_state,
 CASE l_partkey % 7 WHEN 0 THEN 'removed' WHEN 1 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'bogus' ELSE 'valid' END ELSE 'valid' END AS wear_state,
 CASE l_suppkey % 6 WHEN 0 THEN 'rest' WHEN 1 THEN 'odd' ELSE 'active' END AS phase, l_suppkey % 2 = 0 AS window_trainable, CASE l_suppkey % 4 WHEN 0 THEN 'video_review' WHEN 2 THEN 'manual_timeline' ELSE 'guess' END AS label_source,
 CASE l_linenumber WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS confidence FROM lineitem),
o AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 50 = 0 THEN '1.0' ELSE '2.0' END AS schema_version, o_totalprice / 1500 AS dur, CASE o_custkey % 6 WHEN 1 THEN 'legacy_reviewed' WHEN 2 THEN 'session_weak' WHEN 3 THEN 'rejected' WHEN 4 THEN 'bogus' ELSE 'gold' END AS tier,
 CASE WHEN o_totalprice / 1500 > 180 AND o_orderkey % 3 <> 0 THEN 'session_weak' ELSE 'full_recording' END AS scope, o_orderkey % 4 <> 0 AS trainable, o_orderkey % 37 = 0 AS no_taxonomy, CASE o_orderkey % 5 WHEN 0 THEN '跑步机走路' WHEN 1 THEN '爬坡20' WHEN 2 THEN '蹬腿3组' ELSE '深蹲' END AS raw_action FROM orders),
p AS (SELECT s.*, o.*, coalesce(greatest(0, max(end_s) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS prev FROM s JOIN o ON doc_id = l_orderkey),
e AS (SELECT doc_id, -6 AS i, 1 AS j, 'schema_version must be 2.0' AS msg FROM o WHERE schema_version <> '2.0' UNION ALL SELECT doc_id, -5, 1, 'missing required fields: taxonomy_version' FROM o WHERE no_taxonomy
 UNION ALL SELECT doc_id, -4, 1, 'evidence_tier is invalid' FROM o WHERE tier = 'bogus' UNION ALL SELECT doc_id, -3, 1, 'recordings over 180 seconds must use session_weak' FROM o WHERE dur > 180 AND scope <> 'session_weak'
 UNION ALL SELECT doc_id, -2, 1, 'session_weak must not contain supervised segments' FROM o WHERE scope = 'session_weak' AND doc_id IN (SELECT l_orderkey FROM s) UNION ALL SELECT doc_id, -1, 1, 'session_weak must set window_trainable=false' FROM o WHERE scope = 'session_weak' AND trainable
 UNION ALL SELECT doc_id, i, UNNEST([1,2,3,4,5,6,7,8,9,10]) , UNNEST([CASE WHEN start_s < prev THEN ' overlaps or is out of order' END, CASE WHEN start_s < 0 OR end_s <= start_s OR dur >= 0 AND end_s > dur + 1e-3 THEN ' has invalid bounds' END,
  CASE WHEN activity_id = 'mystery' THEN '.activity_id is unknown' END, CASE WHEN motion_state = 'weird' THEN '.motion_state is invalid' END, CASE WHEN wear_state = 'bogus' THEN '.wear_state is invalid' END, CASE WHEN wear_state <> 'valid' AND window_trainable THEN ' invalid wear cannot be window_trainable' END,
  CASE WHEN wear_state <> 'valid' AND motion_state IS NOT NULL THEN ' invalid wear must set motion_state=null' END, CASE WHEN phase = 'odd' THEN '.phase is invalid' END, CASE WHEN tier = 'gold' AND window_trainable AND label_source = 'guess' THEN ' gold label source is not accepted' END,
  CASE WHEN tier = 'gold' AND window_trainable AND confidence = 'low' THEN ' gold label confidence is too low' END]) FROM p),
er AS (SELECT doc_id, string_agg(CASE WHEN i >= 0 THEN 'segments[' || i || ']' ELSE '' END || msg, '; ' ORDER BY i, j) AS errors, count(*) AS n FROM e WHERE msg IS NOT NULL GROUP BY 1)
"""
SEGMENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def label_docs(spark, sf):
    """One label document per order, its line items as segments."""
    c = F.col
    li = table(spark, sf, "lineitem").select("l_orderkey", *SEGMENT_ORDER, "l_discount")
    seg = F.struct(*SEGMENT_ORDER, "l_discount")
    arr = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(seg)).alias("raw"))
    ids = F.array(*[F.lit(a) for a in ACTIVITY_IDS])

    def one(x):
        part, sup, line = x["l_partkey"], x["l_suppkey"], x["l_linenumber"]
        start = (line - 1) * 20 + x["l_quantity"] / 10 - 0.5
        return F.struct(
            start.alias("start_s"), (start + x["l_discount"] * 300).alias("end_s"),
            F.when(part % 31 == 0, "mystery").otherwise(F.element_at(ids, (part % 13 + 1).cast("int"))).alias("activity_id"),
            F.when(part % 4 == 0, "motion").when(part % 4 == 1, "non_motion").when(part % 4 == 2, None).when(sup % 5 == 0, "weird").otherwise("motion").alias("motion_state"),
            F.when(part % 7 == 0, "removed").when((part % 7 == 1) & (sup % 3 == 0), "bogus").otherwise("valid").alias("wear_state"),
            F.when(sup % 6 == 0, "rest").when(sup % 6 == 1, "odd").otherwise("active").alias("phase"), (sup % 2 == 0).alias("window_trainable"),
            F.when(sup % 4 == 0, "video_review").when(sup % 4 == 2, "manual_timeline").otherwise("guess").alias("label_source"),
            F.when(line == 1, "low").when(line == 2, "medium").otherwise("high").alias("confidence"))

    k, dur = c("o_orderkey"), c("o_totalprice") / 1500
    u = c("o_custkey") % 6
    o = table(spark, sf, "orders").select(
        k.alias("doc_id"), F.when(k % 50 == 0, "1.0").otherwise("2.0").alias("schema_version"), F.when(k % 37 != 0, "t1").alias("taxonomy_version"), F.lit("2026-01-01").alias("date"),
        F.lit("p1").alias("participant"), F.lit("d1").alias("device"), F.lit("x.csv").alias("csv_file"), F.when((dur > 180) & (k % 3 != 0), "session_weak").otherwise("full_recording").alias("annotation_scope"),
        dur.alias("recording_duration_s"), (k % 4 != 0).alias("window_trainable"), F.lit("ok").alias("annotation_quality"),
        F.when(u == 1, "legacy_reviewed").when(u == 2, "session_weak").when(u == 3, "rejected").when(u == 4, "bogus").otherwise("gold").alias("evidence_tier"),
        F.when(k % 5 == 0, "跑步机走路").when(k % 5 == 1, "爬坡20").when(k % 5 == 2, "蹬腿3组").otherwise("深蹲").alias("raw_action"))
    j = o.join(arr, o.doc_id == arr.l_orderkey, "left").drop("l_orderkey")
    empty = F.array().cast(arr.schema["raw"].dataType)
    return j.withColumn("segments", F.transform(F.coalesce("raw", empty), one)).drop("raw")


def validated(spark, sf):
    return label_docs(spark, sf).withColumn("errors", L.label_errors(ACTIVITY_IDS))


@query("label_validate", sql=DOC_SQL + "SELECT o.doc_id, coalesce(errors, '') AS errors, coalesce(n, 0) AS error_count FROM o LEFT JOIN er ON er.doc_id = o.doc_id")
def q_validate(spark, sf):
    return validated(spark, sf).select("doc_id", F.concat_ws("; ", "errors").alias("errors"), F.size("errors").alias("error_count"))


@query("label_migrate_tier", sql=DOC_SQL + """
, t AS (SELECT doc_id, count(*) FILTER (window_trainable) AS n, count(*) FILTER (window_trainable AND label_source = 'guess') AS bad FROM p GROUP BY 1)
SELECT o.doc_id, CASE WHEN scope = 'session_weak' THEN 'session_weak' WHEN coalesce(n, 0) > 0 AND bad = 0 THEN 'gold' ELSE 'legacy_reviewed' END AS tier FROM o LEFT JOIN t ON t.doc_id = o.doc_id""")
def q_migrate(spark, sf):
    return label_docs(spark, sf).select("doc_id", L.migrate_tier(F.col("annotation_scope"), F.col("segments")).alias("tier"))


@query("label_set_audit", sql=DOC_SQL + """
, v AS (SELECT doc_id, 'schema' AS rule FROM er UNION ALL SELECT DISTINCT doc_id, 'long_has_training_windows' FROM p WHERE dur > 180 AND window_trainable UNION ALL SELECT DISTINCT doc_id, 'wear_artifact_trainable' FROM p WHERE wear_state <> 'valid' AND window_trainable
 UNION ALL SELECT DISTINCT doc_id, 'treadmill_walk_is_run' FROM p WHERE raw_action = '跑步机走路' AND activity_id = 'run' UNION ALL SELECT DISTINCT doc_id, 'incline_not_motion' FROM p WHERE raw_action = '爬坡20' AND window_trainable AND coalesce(motion_state, '') <> 'motion'
 UNION ALL SELECT DISTINCT doc_id, 'long_group_record_segmented' FROM p WHERE dur > 180 AND raw_action = '蹬腿3组' UNION ALL SELECT DISTINCT doc_id, 'trainable_missing_dual_label' FROM p WHERE window_trainable AND coalesce(motion_state, '') NOT IN ('motion', 'non_motion'))
SELECT rule, count(*) AS documents FROM v GROUP BY 1 UNION ALL SELECT '_accepted', count(*) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM v)""")
def q_set_audit(spark, sf):
    d = validated(spark, sf)
    return L.set_violations(d, "doc_id", "_accepted").groupBy("rule").agg(F.count(F.lit(1)).alias("documents"))


REVIEW = [("深蹲0组", "squat", "motion"), ("深蹲1组", "squat", "motion"), ("自由行走", "free_walk", "motion"), ("坐姿", "sitting", "non_motion"), ("佩戴取下", "removed_wear", "non_motion")]
EXCLUDE = [("深蹲2组", "squat", "motion", "truncated", False), ("耳机掉落", "removed_wear", "non_motion", "device fell", True)]
REVIEW_SQL = f""", n AS (SELECT event_id, value, ts, user_id, {NAME_SQL} AS name FROM events), lr AS (SELECT *, CASE name WHEN '深蹲0组' THEN 'squat' WHEN '深蹲1组' THEN 'squat' WHEN '自由行走' THEN 'free_walk' WHEN '坐姿' THEN 'sitting' WHEN '佩戴取下' THEN 'removed_wear'
 WHEN '深蹲2组' THEN 'squat' WHEN '耳机掉落' THEN 'removed_wear' END AS activity_id, CASE WHEN name = '耳机掉落' THEN 'invalid' WHEN name = '佩戴取下' THEN 'removed' WHEN name IN ('深蹲0组','深蹲1组','深蹲2组','自由行走','坐姿') THEN 'valid' END AS wear_state,
 CASE WHEN name IN ('深蹲0组','深蹲1组','深蹲2组','自由行走') THEN 'motion' WHEN name = '坐姿' THEN 'non_motion' END AS motion_state, CASE WHEN name IN ('耳机掉落','佩戴取下') THEN 'artifact' WHEN name = '深蹲2组' THEN 'transition' WHEN name IN ('深蹲0组','深蹲1组','自由行走') THEN 'active' WHEN name = '坐姿' THEN 'rest' END AS phase,
 CASE WHEN name IN ('深蹲0组','深蹲1组','自由行走','坐姿') THEN true WHEN name IN ('耳机掉落','佩戴取下','深蹲2组') THEN false END AS window_trainable FROM n)
"""


def reviewed(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", "value", F.expr(NAME_SQL).alias("name"))
    rv = spark.createDataFrame(REVIEW, "raw_name string, activity_id string, motion string")
    ex = spark.createDataFrame(EXCLUDE, "raw_name string, activity_id string, motion string, reason string, bad_wear boolean")
    return L.label_review(d, "name", rv, ex)


@query("label_review", sql=REVIEW_SQL + "SELECT event_id, activity_id, wear_state, motion_state, phase, window_trainable FROM lr")
def q_review(spark, sf):
    return reviewed(spark, sf).select("event_id", "activity_id", "wear_state", "motion_state", "phase", "window_trainable")


CONVERT_SQL = REVIEW_SQL + """, cv AS (SELECT *, CASE WHEN value > 180 THEN 'session_weak' WHEN wear_state IS NULL THEN 'rejected' ELSE 'legacy_reviewed' END AS evidence_tier,
 CASE WHEN value > 180 THEN 'session_weak' WHEN wear_state IS NULL THEN 'review_required' ELSE 'full_recording' END AS annotation_scope, coalesce(value <= 180 AND wear_state IS NOT NULL AND window_trainable, false) AS doc_trainable,
 CASE WHEN value > 180 OR wear_state IS NULL THEN 0 ELSE 1 END AS segments, CASE WHEN value > 180 OR wear_state IS NOT NULL THEN 'legacy' ELSE 'legacy_unreviewed' END AS compatibility_source FROM lr)
"""


@query("label_convert_legacy", sql=CONVERT_SQL + "SELECT event_id, evidence_tier, annotation_scope, doc_trainable, segments, compatibility_source FROM cv")
def q_convert(spark, sf):
    d = L.convert_legacy(reviewed(spark, sf).withColumnRenamed("value", "duration_s"))
    return d.select("event_id", "evidence_tier", "annotation_scope", "doc_trainable", F.size("segments").alias("segments"), "compatibility_source")


@query("label_build", sql=CONVERT_SQL + """
SELECT event_id, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE evidence_tier END AS evidence_tier, CASE WHEN c_custkey IS NOT NULL THEN 'stored' ELSE annotation_scope END AS annotation_scope, c_custkey IS NOT NULL AS preserved FROM cv LEFT JOIN customer ON c_custkey = event_id""")
def q_build(spark, sf):
    d = L.convert_legacy(reviewed(spark, sf).withColumnRenamed("value", "duration_s"))
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("evidence_tier"), F.lit("stored").alias("annotation_scope"))
    return L.keep_existing(d, e, "event_id", ["evidence_tier", "annotation_scope"]).select("event_id", "evidence_tier", "annotation_scope", "preserved")


@query("weak_targets_build", sql="""
, l AS (SELECT user_id, event_type AS a, min(event_id) AS p FROM events WHERE event_type <> 'error' GROUP BY 1, 2), pp AS (SELECT s_suppkey AS user_id, 'warmup' AS a, 0 AS p, CAST(NULL AS BIGINT) AS sets, 0 AS k FROM supplier UNION ALL SELECT s_suppkey, 'press', 1, s_nationkey % 5, 0 FROM supplier),
b AS (SELECT c_custkey AS user_id, 'squat' AS a, 0 AS p, c_nationkey % 4 AS sets, 1 AS k FROM customer WHERE c_custkey % 2 = 0), x AS (SELECT * FROM pp UNION ALL SELECT * FROM b UNION ALL SELECT user_id, a, p, NULL, 2 FROM l),
y AS (SELECT *, min(k) OVER (PARTITION BY user_id) AS best, sum(sets) FILTER (k = k) OVER (PARTITION BY user_id, k) AS t FROM x)
SELECT user_id, p AS position, a AS activity_id, sets, CASE WHEN t > 0 THEN CAST(t AS BIGINT) END AS total_sets FROM y WHERE k = best""")
def q_weak(spark, sf):
    n = lambda c: F.col(c).cast("long")
    s = table(spark, sf, "supplier")
    warm = s.select(F.col("s_suppkey").alias("user_id"), F.lit(0).cast("long").alias("position"), F.lit("warmup").alias("activity_id"), F.lit(None).cast("long").alias("sets"))
    press = s.select(F.col("s_suppkey").alias("user_id"), F.lit(1).cast("long").alias("position"), F.lit("press").alias("activity_id"), (n("s_nationkey") % 5).alias("sets"))
    named = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("position"), F.lit("squat").alias("activity_id"), (n("c_nationkey") % 4).alias("sets"))
    ev = table(spark, sf, "events").select("user_id", F.col("event_id").alias("position"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("activity_id"))
    legacy = L.first_seen(ev, ["user_id"], "activity_id", "position").withColumn("sets", F.lit(None).cast("long"))
    return L.weak_targets(warm.unionByName(press), named, legacy, ["user_id"])


POLICY_SQL = f""", n AS (SELECT event_id, user_id, {NAME_SQL} AS name, CASE WHEN event_id % 3 = 0 THEN 'exercise' WHEN event_id % 3 = 1 THEN 'non_exercise' END AS st FROM events),
q AS (SELECT *, coalesce(st, 'unlabelled') AS input_state, CASE WHEN name LIKE '佩戴取下%' OR name LIKE '%掉落%' THEN 'wear_artifact' WHEN name LIKE '深蹲%' THEN 'exercise' WHEN name LIKE '自由行走%' THEN 'ambiguous' WHEN name LIKE '坐姿%' THEN 'non_exercise' ELSE 'unlabelled' END AS taxonomy_state FROM n)
"""


def policied(spark, sf):
    e = F.col("event_id")
    d = table(spark, sf, "events").select("event_id", "user_id", F.expr(NAME_SQL).alias("name"), F.when(e % 3 == 0, "exercise").when(e % 3 == 1, "non_exercise").alias("state"))
    return L.label_policy(d, "taxonomy", None, "name", "state")


@query("label_policy", sql=POLICY_SQL + "SELECT event_id, input_state, taxonomy_state, taxonomy_state AS state, input_state <> taxonomy_state AS label_changed FROM q")
def q_policy(spark, sf):
    return policied(spark, sf).select("event_id", "input_state", "taxonomy_state", "state", "label_changed")


@query("label_audit", sql=POLICY_SQL + "SELECT name, input_state, taxonomy_state, count(*) AS windows, count(DISTINCT user_id) AS capture_sessions FROM q GROUP BY 1, 2, 3")
def q_audit(spark, sf):
    return L.label_audit(policied(spark, sf), "name", "user_id")


@query("scope_counts", sql=DOC_SQL + """
SELECT scope AS annotation_scope, count(*) AS documents, count_if(dur <= 180) AS short_count, count_if(dur > 180) AS long_session_count, count_if(trainable AND l IS NOT NULL) AS window_trainable_count FROM o LEFT JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem) z ON l = doc_id GROUP BY 1""")
def q_scope(spark, sf):
    c = F.col
    return label_docs(spark, sf).groupBy("annotation_scope").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(c("recording_duration_s") <= 180).alias("short_count"), F.count_if(c("recording_duration_s") > 180).alias("long_session_count"),
        F.count_if(c("window_trainable") & (F.size("segments") > 0)).alias("window_trainable_count"))


@query("posture_label_by_name", sql="""
, n AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '0101-a-坐姿' WHEN 1 THEN '0101-a-坐姿2' WHEN 2 THEN '0102-b-左右偏头' WHEN 3 THEN '0102-b-低头' WHEN 4 THEN '0103-c-抬头2' WHEN 5 THEN '0103-c-左看' WHEN 6 THEN '右看挂脖子' WHEN 7 THEN 'x-坐姿说话' ELSE event_type END AS stem FROM events)
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'normal' WHEN 1 THEN 'normal' WHEN 2 THEN 'head_tilt' WHEN 3 THEN 'head_down' WHEN 4 THEN 'head_up' WHEN 5 THEN 'head_turn' END AS label,
 CASE WHEN event_id % 9 < 6 THEN split_part(stem, '-', 1) ELSE 'unknown-date' END AS date, CASE WHEN event_id % 9 < 6 THEN split_part(stem, '-', 2) ELSE stem END AS subject FROM n""")
def q_posture_name(spark, sf):
    stem = F.expr("""CASE event_id % 9 WHEN 0 THEN '0101-a-坐姿' WHEN 1 THEN '0101-a-坐姿2' WHEN 2 THEN '0102-b-左右偏头' WHEN 3 THEN '0102-b-低头' WHEN 4 THEN '0103-c-抬头2' WHEN 5 THEN '0103-c-左看' WHEN 6 THEN '右看挂脖子' WHEN 7 THEN 'x-坐姿说话' ELSE event_type END""")
    d = table(spark, sf, "events").select("event_id", stem.alias("stem"))
    p = F.split("stem", "-", 3)
    three = F.size(p) >= 3
    return d.select("event_id", posture_by_name(F.col("stem")).alias("label"), F.when(three, F.get(p, F.lit(0))).otherwise("unknown-date").alias("date"),
                    F.when(three, F.get(p, F.lit(1))).otherwise(F.col("stem")).alias("subject"))


# --- timelines -------------------------------------------------------------------------------


@query("timeline_gap_fill", uses="segments1", sql="""
, rec AS (SELECT device, min(start_us) / 1e6 + 30 AS rs, max(start_us) / 1e6 + 60 AS re FROM segments1 GROUP BY 1),
s AS (SELECT device, segment_id, activity, greatest(start_us / 1e6, rs) AS s, least(start_us / 1e6 + duration_s * 200, re) AS e, rs, re FROM segments1 JOIN rec USING (device)),
k AS (SELECT *, greatest(rs, coalesce(max(e) OVER (PARTITION BY device ORDER BY s, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rs)) AS cur FROM s WHERE s < e),
u AS (SELECT device, cur AS s, s AS e, 'unlabelled' AS activity, true AS filler FROM k WHERE s > cur UNION ALL SELECT device, greatest(s, cur), e, activity, false FROM k WHERE greatest(s, cur) < e
 UNION ALL SELECT device, coalesce(m, rs), re, 'unlabelled', true FROM rec LEFT JOIN (SELECT device, max(e) AS m FROM k GROUP BY 1) z USING (device) WHERE coalesce(m, rs) < re)
SELECT device, round(s, 6) + 0.0 AS start_s, round(e, 6) + 0.0 AS end_s, activity, filler FROM u""")
def q_timeline(spark, sf):
    c = F.col
    s = segments1(spark, sf).withColumns({"start": c("start_us") / 1e6, "end": c("start_us") / 1e6 + c("duration_s") * 200})
    rec = segments1(spark, sf).groupBy("device").agg((F.min("start_us") / 1e6 + 30).alias("rec_start"), (F.max("start_us") / 1e6 + 60).alias("rec_end"))
    t = L.timeline_gap_fill(s, rec, ["device"], "segment_id", "activity", 3600.0)
    return t.select("device", r(c("start"), 6).alias("start_s"), r(c("end"), 6).alias("end_s"), "activity", "filler")


@query("time_regressions", sql="""
, t AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - CASE WHEN event_id % 13 = 0 THEN 200000 ELSE 0 END AS s FROM events), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM t)
SELECT user_id, count(*) AS row_count, round(min(s), 6) + 0.0 AS start_s, round(max(s), 6) + 0.0 AS end_s, count_if(s < p) AS regression_count, round(greatest(coalesce(max(p - s), 0), 0), 6) + 0.0 AS max_regression_seconds FROM l GROUP BY 1""")
def q_regressions(spark, sf):
    e = F.col("event_id")
    d = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros("ts") / F.lit(1e6) - F.when(e % 13 == 0, 200000).otherwise(0)).alias("s"))
    t = L.time_regressions(d, ["user_id"], ["event_id"], F.floor(e / 65536), "s")
    return t.withColumns({c: r(F.col(c), 6) for c in ("start_s", "end_s", "max_regression_seconds")})


@query("fragment_continuity", sql="""
, f AS (SELECT user_id, 'rec_' || CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) // 2 AS BIGINT) || '.csv' AS name, date_diff('day', TIMESTAMP '2024-01-01', ts) // 2 AS n, min(epoch_us(ts)) / 1e6 AS s, max(epoch_us(ts)) / 1e6 AS e FROM events GROUP BY ALL),
l AS (SELECT *, s - lag(e) OVER (PARTITION BY user_id ORDER BY n) AS gap FROM f)
SELECT user_id, name, round(gap, 6) + 0.0 AS gap_seconds, coalesce(gap < -0.1 OR gap > 40000, false) AS discontinuous FROM l""")
def q_fragments(spark, sf):
    d = fragments(spark, sf).groupBy("user_id", "name").agg((F.min(F.unix_micros("ts")) / 1e6).alias("start"), (F.max(F.unix_micros("ts")) / 1e6).alias("end"))
    f = L.fragment_continuity(d, ["user_id"], "name", 40000.0)
    return f.select("user_id", "name", r(F.col("gap_seconds"), 6).alias("gap_seconds"), "discontinuous")


def fragments(spark, sf):
    day = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 2)
    return table(spark, sf, "events").select("user_id", "event_id", "ts", F.concat(F.lit("rec_"), day.cast("string"), F.lit(".csv")).alias("name"))


@query("merge_fragments", sql="""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_diff('day', TIMESTAMP '2024-01-01', ts) // 2, event_id) - 1 AS row_index FROM events""")
def q_merge(spark, sf):
    return L.merge_fragments(fragments(spark, sf), ["user_id"], "name", "event_id").select("user_id", "event_id", "row_index")


@query("convert_legacy_text", sql="""
, t AS (SELECT user_id, event_id, epoch_us(ts) - CASE WHEN event_id % 13 = 0 THEN 200000000000 ELSE 0 END AS us, CASE WHEN event_id % 2003 = 0 THEN 3 ELSE 4 END AS fields FROM events),
b AS (SELECT user_id, count_if(fields <> 4) AS bad FROM t GROUP BY 1)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS row_index FROM t JOIN b USING (user_id) WHERE bad = 0""")
def q_legacy_text(spark, sf):
    e = F.col("event_id")
    d = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros("ts") - F.when(e % 13 == 0, 200000000000).otherwise(0)).alias("us"), F.when(e % 2003 == 0, 3).otherwise(4).alias("fields"))
    return convert_legacy_text(d, ["user_id"], "us", "event_id", "fields", 4).select("user_id", "event_id", "row_index")


def convert_legacy_text(d, key, ts, row, fields, expected):
    """Time-sorted rows of the files whose every line has the header's number of fields (all or nothing)."""
    from ..operators.ordered import number_rows, spread_join

    whole = d.groupBy(*key).agg(F.bool_and(F.col(fields) == expected).alias("_ok"))
    good = spread_join(d, whole, key).filter("_ok").drop("_ok")
    return number_rows(good, key, [ts, row], F.floor(F.col(ts) / 3600000000), "row_index")


# --- trials ----------------------------------------------------------------------------------



def trial_reports(spark, sf, report=None, docs=None):
    """Trials pair neighbouring devices; their label document has the trial's number. ``report`` of the streams (written) and validated ``docs``: those of the other queries, if not given."""
    streams = (staged(stream_report(spark, sf), "streams") if report is None else report).withColumn("trial", F.floor(F.col("device") / 2))
    labels = (validated(spark, sf) if docs is None else docs).select(F.col("doc_id").alias("trial"), "errors", "evidence_tier")
    u = F.col("device")
    pair = J.dual_stream_pair(streams.select("trial", F.when(u % 2 == 0, "left").otherwise("right").alias("side"), (u * 37 % 700 * 1000000).alias("ns")), "trial", "side", "ns")
    return L.trial_audit(streams, labels, pair, "trial", "device")


TRIAL_SQL = DOC_SQL.replace(", s AS (SELECT l_orderkey", ", sg AS (SELECT l_orderkey").replace("FROM s JOIN o ON", "FROM sg s JOIN o ON").replace("SELECT l_orderkey FROM s)", "SELECT l_orderkey FROM sg)").replace("o AS (SELECT o_orderkey AS doc_id", "od AS (SELECT o_orderkey AS doc_id").replace("s.*, o.*", "s.*, od.*").replace("JOIN o ON doc_id", "JOIN od ON doc_id").replace("FROM o WHERE", "FROM od WHERE").replace("e AS (SELECT doc_id, -6", "ee AS (SELECT doc_id, -6").replace("FROM e WHERE", "FROM ee WHERE")
TRIAL = STREAM_SQL + TRIAL_SQL + """
, st AS (SELECT device // 2 AS trial, device, issues, clipped, device * 37 % 700 AS ms, device % 2 AS side FROM q),
gg AS (SELECT trial, count(*) AS streams, count(DISTINCT side) = 2 AS both_sides, max(ms) - min(ms) AS off, max(clipped) AS clip FROM st GROUP BY 1),
si AS (SELECT trial, device || ':' || UNNEST(string_split(issues, ';')) AS issue FROM st WHERE issues <> ''),
sa AS (SELECT trial, string_agg(issue, '|' ORDER BY issue) AS stream_issues, bool_or(regexp_matches(issue, '(timestamp_not_strictly_increasing|sample_rate_outside_5_percent|non_finite_sensor_value)$')) AS fatal FROM si GROUP BY 1),
x AS (SELECT g.trial, CASE WHEN od.doc_id IS NULL THEN 'label file missing' ELSE replace(er.errors, '; ', '|') END AS label_errors, streams, both_sides, off, clip, stream_issues, coalesce(fatal, false) AS fatal, tier FROM gg g LEFT JOIN sa USING (trial) LEFT JOIN od ON od.doc_id = g.trial LEFT JOIN er ON er.doc_id = g.trial),
y AS (SELECT trial, concat_ws('|', label_errors, CASE WHEN streams <> 2 THEN 'dual_ear_stream_missing' END, CASE WHEN NOT both_sides THEN 'left_right_pair_incomplete' END, CASE WHEN streams = 2 AND off > 100 THEN 'left_right_sync_offset' END, stream_issues) AS issues,
 label_errors IS NOT NULL OR streams <> 2 OR NOT both_sides OR off > 500 OR fatal OR clip > 0.02 AS hard, label_errors, tier FROM x)
"""


@query("trial_audit", uses="imu6", sql=TRIAL + "SELECT trial, issues, CASE WHEN hard THEN 'recollect_required' WHEN issues <> '' THEN 'accepted_with_note' ELSE 'accepted' END AS status, CASE WHEN hard THEN 'rejected' ELSE tier END AS evidence_tier FROM y")
def q_trial(spark, sf):
    return trial_reports(spark, sf).withColumn("issues", F.concat_ws("|", "issues"))


@query("session_audit", uses="imu6", sql=TRIAL + """
, m AS (SELECT device // 10 AS session, device // 2 AS trial, 1 AS n FROM (SELECT DISTINCT device FROM imu6) z GROUP BY 1, 2),
w AS (SELECT session, coalesce(label_errors = 'label file missing', hard IS NULL) AS miss, hard FROM m LEFT JOIN y USING (trial))
SELECT session, count(*) AS trials, count_if(miss) AS missing_labels, 0 AS duplicate_trials, count_if(hard AND NOT miss) AS recollect, count_if(miss) + count_if(hard AND NOT miss) AS violation_count, count_if(miss) + count_if(hard AND NOT miss) = 0 AS accepted FROM w GROUP BY 1""")
def q_session(spark, sf):
    li = table(spark, sf, "lineitem").select(F.floor(F.col("l_suppkey") / 10).alias("session"), F.floor(F.col("l_suppkey") / 2).alias("trial")).distinct()
    return L.session_audit(trial_reports(spark, sf), li, "session", "trial")
