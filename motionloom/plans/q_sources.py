"""Queries: sources and sinks. Files are first written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded as r
from ..operators import clean as C
from ..operators import episodes as EP
from ..operators import joins as J
from ..operators import labels as L
from ..operators import posture as P
from ..operators import quality as Q
from ..operators import resample as R
from ..operators import timeaxis as TA
from ..operators import windows as WN
from ..operators.ordered import number_rows, spread_join
from ..session import scratch_path, staged
from ..sources import files as FS
from ..sources import sinks as SK
from ..streaming import sources as SS
from .q_joins import segment_windows
from .q_labels import label_docs, trial_reports
from .q_quality import strict_stream
from .q_scalar import ACTIVITY_IDS
from .q_windows import MAP, with_quats
from .registry import query
from .views import AXES, imu6, segments6_of, table

DEV = ["device"]
HEADER = ["时间", " 设备名称", "加速度X(g)", " 加速度Y(g)", "片上时间()"]


def vendor_log(spark, sf, sep, suffix):
    """events as vendor logs: BOM, padded header, one surplus trailing field per row."""
    path = scratch_path(spark, f"vendor-{suffix}")
    e = F.col("event_id")
    fields = [F.date_format("ts", "HH:mm:ss.SSSSSS"), F.concat(F.lit(" WT"), F.col("user_id").cast("string")), F.when(e % 17 == 0, "bad").otherwise(F.col("value").cast("string")), e.cast("string"), F.col("event_type"), F.lit("")]
    d = table(spark, sf, "events").select(F.concat_ws(sep, *fields).alias("value"))
    SK.write_lines(d, "﻿" + sep.join(HEADER), "value", path)
    return path


LOG_SQL = """SELECT strftime(ts, '%H:%M:%S.%f') AS host, 'WT' || user_id AS device, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS ax, CAST(event_id AS DOUBLE) AS ay, event_type AS chip FROM events"""


def log_columns(d):
    names = {"时间": "host", "设备名称": "device", "加速度X(g)": "ax", "加速度Y(g)": "ay", "片上时间()": "chip"}
    return d.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query("scan_logger_csv", sql=LOG_SQL)
def q_csv(spark, sf):
    return log_columns(FS.scan_logger_csv(spark, vendor_log(spark, sf, ",", "csv")))


@query("scan_logger_tsv", sql=LOG_SQL)
def q_tsv(spark, sf):
    return log_columns(FS.scan_logger_tsv(spark, vendor_log(spark, sf, "\t", "txt")))


@query("discover_captures", sql="SELECT user_id AS number, row_number() OVER (ORDER BY user_id) AS position FROM (SELECT DISTINCT user_id FROM events) z")
def q_discover(spark, sf):
    path = scratch_path(spark, "captures")
    folder = F.coalesce(F.concat(F.lit("rec"), F.col("user_id").cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = table(spark, sf, "events").select(F.concat(F.lit("rec="), folder, F.lit("/capture.csv")).alias("file"), F.to_csv(F.struct("event_id", "value")).alias("line"))
    SK.write_small_files(rows, "file", "line", path)
    d = FS.discover_captures(spark, path)
    f = d.groupBy(F.regexp_extract("path", r"rec=rec(\d+)", 1).cast("long").alias("number")).agg(F.min("natural").alias("k"))
    n = number_rows(f.withColumn("_all", F.lit(0)), ["_all"], ["k"], F.regexp_extract("k", "^(.*rec\u0001[0-9]{6})", 1), "position")
    return n.select("number", (F.col("position") + 1).alias("position"))


PATH_SQL = """'/raw/26-07-20-' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || CASE event_id % 4 WHEN 0 THEN '/甲乙+丙丁-走路3.0 (' || (event_id % 5 + 1) || ')/_dev' || user_id || '(AA-bb-cc-dd-ee-0' || (user_id % 10) || ').csv'
 WHEN 1 THEN '/甲乙+丙丁 坐起 (2)/left' || user_id || '.txt' WHEN 2 THEN '/自由走路/data.csv' ELSE '/misc/深蹲__txt.txt' END"""


@query("path_metadata", sql=f"""
, p AS (SELECT event_id, user_id, '26-07-20-' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS ses FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '慢走' WHEN 1 THEN '坐下起立' WHEN 2 THEN '自由行走' ELSE '深蹲' END AS activity, CASE event_id % 4 WHEN 0 THEN event_id % 5 + 1 WHEN 1 THEN 2 ELSE 1 END AS trial,
 CASE WHEN event_id % 4 < 2 THEN '甲乙+丙丁' ELSE 'unknown' END AS subject_group, ses AS session_name, CASE event_id % 4 WHEN 0 THEN 'aa-bb-cc-dd-ee-0' || (user_id % 10) WHEN 1 THEN 'left' || user_id WHEN 2 THEN 'data' ELSE '深蹲__txt' END AS device_id,
 CASE event_id % 4 WHEN 0 THEN '慢走__' || ses || '__aa-bb-cc-dd-ee-0' || (user_id % 10) || '__csv' WHEN 1 THEN '坐下起立__' || ses || '__left' || user_id || '__txt' WHEN 2 THEN '自由走路__csv' ELSE '深蹲__txt' END AS recording FROM p""")
def q_path(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    ses = F.concat(F.lit("/raw/26-07-20-"), F.lpad((u % 1000).cast("string"), 3, "0"))
    s = lambda c: c.cast("string")
    tail = (F.when(e % 4 == 0, F.concat(F.lit("/甲乙+丙丁-走路3.0 ("), s(e % 5 + 1), F.lit(")/_dev"), s(u), F.lit("(AA-bb-cc-dd-ee-0"), s(u % 10), F.lit(").csv")))
            .when(e % 4 == 1, F.concat(F.lit("/甲乙+丙丁 坐起 (2)/left"), s(u), F.lit(".txt"))).when(e % 4 == 2, "/自由走路/data.csv").otherwise("/misc/深蹲__txt.txt"))
    d = FS.path_metadata(table(spark, sf, "events").select("event_id", F.concat(ses, tail).alias("path")), "path")
    return d.select("event_id", "activity", F.col("trial").cast("long").alias("trial"), "subject_group", "session_name", "device_id", "recording")


@query("capture_identity", sql="""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '0720' ELSE 'unknown-date' END AS date, CASE event_id % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'u' || user_id WHEN 2 THEN 'x' ELSE 'unknown-subject' END AS subject,
 CASE event_id % 4 WHEN 0 THEN event_type || '-2' WHEN 1 THEN event_type WHEN 2 THEN 'u' || user_id || '-' || event_type || '-b' ELSE event_type END AS raw_action FROM events""")
def q_identity(spark, sf):
    e, u = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    t = F.col("event_type")
    stem = (F.when(e % 4 == 0, F.concat_ws("-", F.lit("0720"), u, t, F.lit("2"))).when(e % 4 == 1, F.concat_ws("-", u, t)).when(e % 4 == 2, F.concat_ws("-", F.lit("x"), u, t, F.lit("b"))).otherwise(t))
    date, subject, action = FS.capture_identity(F.col("stem"))
    return table(spark, sf, "events").select("event_id", stem.alias("stem")).select("event_id", date.alias("date"), subject.alias("subject"), action.alias("raw_action"))


@query("scan_strict_stream", sql="SELECT event_id * 1000 AS timestamp_monotonic_ns, event_id % 65536 AS sequence_id, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS ear_side, value AS acc_x, value / 2 AS gyro_z FROM events")
def q_strict(spark, sf):
    path = scratch_path(spark, "strict")
    e, v = F.col("event_id"), F.col("value")
    table(spark, sf, "events").select(
        (e * 1000).alias("timestamp_monotonic_ns"), (e % 65536).alias("sequence_id"), F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("ear_side"), v.alias("acc_x"), v.alias("acc_y"), v.alias("acc_z"),
        v.alias("gyro_x"), v.alias("gyro_y"), (v / 2).alias("gyro_z"), F.lit("x").alias("note")).write.option("header", True).csv(path)
    return FS.scan_strict(spark, path).select("timestamp_monotonic_ns", "sequence_id", "ear_side", "acc_x", "gyro_z")


@query("scan_manifest", sql="""
, o AS (SELECT o_orderkey // 8 AS ses, o_orderkey, count(*) OVER (PARTITION BY o_orderkey // 8, o_orderkey % 7) AS same FROM orders)
SELECT 's' || ses AS session_id, 't' || (o_orderkey % 7) AS trial_id, side AS ear_side, concat_ws(';', CASE WHEN ses % 31 = 0 THEN 'schema_version must be 1.0' END, CASE WHEN same > 1 THEN 'trial_id must occur exactly once' END,
 CASE WHEN o_orderkey % 11 = 0 THEN 'trial missing label_file' END, CASE WHEN o_orderkey % 13 = 0 THEN 'duplicate device stream' END, CASE WHEN o_orderkey % 5 = 0 THEN 'device stream missing sha256' END) AS errors
FROM o, LATERAL (SELECT UNNEST(['left', CASE WHEN o_orderkey % 13 = 0 THEN 'left' ELSE 'right' END]) AS side)""")
def q_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    k, u = F.col("o_orderkey"), F.col("ses")
    stream = lambda side: F.struct(F.lit("d1").alias("device_id"), side.alias("ear_side"), F.lit("a.csv").alias("csv_file"), F.when(k % 5 != 0, "ab").alias("sha256"), F.lit(50.0).alias("sample_rate_configured_hz"), F.lit("g").alias("acceleration_unit"),
                                   F.lit("deg/s").alias("angular_velocity_unit"), F.lit(16.0).alias("acceleration_range"), F.lit(2000.0).alias("angular_velocity_range"), F.lit("none").alias("filter_config"), F.lit("1").alias("firmware_version"))
    trial = F.struct(F.concat(F.lit("t"), (k % 7).cast("string")).alias("trial_id"), F.when(k % 11 != 0, "l.json").alias("label_file"),
                     F.array(stream(F.lit("left")), stream(F.when(k % 13 == 0, "left").otherwise("right"))).alias("streams"))
    m = table(spark, sf, "orders").groupBy(F.floor(k / 8).alias("ses")).agg(F.collect_list(trial).alias("trials"))  # eight order keys make one session document
    doc = F.struct(F.when(u % 31 == 0, "0.9").otherwise("1.0").alias("schema_version"), F.lit("p").alias("protocol_version"), F.lit("2026-01-01").alias("date"), F.concat(F.lit("s"), u.cast("string")).alias("session_id"),
                   F.lit("sub").alias("subject_id"), F.lit("c").alias("collector_id"), F.lit("1").alias("app_version"), "trials")
    m.select(F.to_json(doc).alias("value")).write.text(path)
    d = FS.scan_manifest(spark, path, multi_line=False)
    return d.select("session_id", "trial_id", "ear_side", F.concat_ws(";", "errors").alias("errors"))


@query("scan_label_docs", sql="""
SELECT o_orderkey AS doc_id, o_orderkey % 9 = 0 AS legacy, CASE WHEN o_totalprice / 1500 > 180 THEN 'recordings over 180 seconds must use session_weak' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_totalprice / 1500 > 180 THEN ';' ELSE '' END || 'segments[0] has invalid bounds' ELSE '' END AS errors
FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey, true, '' FROM orders WHERE o_orderkey % 9 = 0""")
def q_docs(spark, sf):
    path = scratch_path(spark, "labels")
    k = F.col("o_orderkey")
    seg = F.struct(F.lit(0.0).alias("start_s"), F.when(k % 4 == 0, 0.0).otherwise(0.1).alias("end_s"), F.lit("squat").alias("activity_id"), F.lit("motion").alias("motion_state"), F.lit("valid").alias("wear_state"), F.lit("active").alias("phase"),
                   F.lit(True).alias("window_trainable"), F.lit("video_review").alias("label_source"), F.lit("high").alias("confidence"))
    doc = F.struct(F.when(k % 9 == 0, "1.0").otherwise("2.0").alias("schema_version"), F.lit("t").alias("taxonomy_version"), F.lit("2026-01-01").alias("date"), F.lit("p").alias("participant"), F.lit("d").alias("device"),
                   k.cast("string").alias("csv_file"), F.lit("full_recording").alias("annotation_scope"), F.struct((F.col("o_totalprice") / 1500).alias("duration_seconds")).alias("recording"), F.lit(True).alias("window_trainable"),
                   F.lit("ok").alias("annotation_quality"), F.lit("gold").alias("evidence_tier"), F.array(seg).alias("segments"))
    table(spark, sf, "orders").select(F.to_json(doc).alias("value")).write.text(path)
    d = FS.scan_label_docs(spark, path, multi_line=False)
    e = F.when(F.col("legacy"), "").otherwise(F.concat_ws(";", L.label_errors(ACTIVITY_IDS)))
    return d.select(F.col("csv_file").cast("long").alias("doc_id"), "legacy", e.alias("errors"))


@query("scan_timeline", sql="SELECT 'f' || user_id || '.csv' AS source_file, round(value, 6) + 0.0 AS start_s, event_type AS activity_id, 'valid' AS wear_state, true AS window_trainable, 'rejected' AS evidence_tier FROM events")
def q_timeline(spark, sf):
    path = scratch_path(spark, "timeline")
    v = F.col("value")
    table(spark, sf, "events").select(F.concat(F.lit("data\\sub/f"), F.col("user_id").cast("string"), F.lit(".csv")).alias("source_file"), v.alias("start_s"), (v + 10).alias("end_s"), F.col("event_type").alias("action_id"),
                                      F.lit("active").alias("phase")).write.option("header", True).csv(path)
    return FS.scan_timeline(spark, path).select("source_file", r(F.col("start_s")).alias("start_s"), "activity_id", "wear_state", "window_trainable", "evidence_tier")


@query("scan_posture_segments", sql="""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'normal' WHEN event_id % 7 = 1 THEN 'head_down' WHEN event_id % 7 = 2 THEN 'head_up' WHEN event_id % 7 = 3 THEN 'head_tilt' WHEN event_id % 7 = 4 THEN 'head_turn' ELSE 'head_down' END AS label FROM events
WHERE event_id % 3 <> 0 AND event_id % 7 <> 6 AND NOT (event_id % 7 = 5 AND event_id % 2 = 0)""")
def q_posture_segments(spark, sf):
    e = F.col("event_id")
    dev = (F.when(e % 7 == 1, F.array(F.lit("head_tilt_left"), F.lit("head_down"))).when(e % 7 == 2, F.array(F.lit("head_up"), F.lit("head_turn_left"))).when(e % 7 == 3, F.array(F.lit("head_tilt_right")))
           .when(e % 7 == 4, F.array(F.lit("head_turn_left"))).when(e % 7 == 5, F.array(F.lit("forward_head_candidate"), F.lit("head_down"))).otherwise(F.array().cast("array<string>")))
    d = table(spark, sf, "events").select("event_id", F.when(e % 7 == 0, "normal").otherwise("poor").alias("posture_state"), dev.alias("deviations"), F.when(e % 2 == 1, "video_review").alias("reference_source"), (e % 3 != 0).alias("window_trainable"))
    return P.posture_segments(d).select("event_id", "label")


@query("scan_notes", sql=r"SELECT count(*) AS notes, CAST(sum(length(turn || ':' || role || ':' || trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\v\f]+', ' ', 'g'), ' ') || '.')) AS BIGINT) AS characters FROM conversations")
def q_notes(spark, sf):
    path = scratch_path(spark, "notes")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0B\f]+", " "))
    line = F.concat(F.col("turn").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), text, F.lit("."))
    # many small note files, as a session folder has them
    table(spark, sf, "conversations").select(line.alias("value")).repartition(32).write.option("maxRecordsPerFile", 2000).text(path)
    n = FS.scan_notes(spark, path).select(F.explode(F.filter(F.split("content", "\n"), lambda x: x != "")).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("notes"), F.sum(F.length("n")).alias("characters"))


@query("file_sha256_check", sql="SELECT grp, grp % 3 <> 0 AS sha256_valid FROM (SELECT DISTINCT user_id % 20 AS grp FROM events) z")
def q_sha(spark, sf):
    path = scratch_path(spark, "sha")
    table(spark, sf, "events").select((F.col("user_id") % 20).alias("grp"), "event_id", "value").repartition("grp").write.partitionBy("grp").csv(path)
    # the manifest is made from the files themselves; every third digest is wrong
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    grp = F.regexp_extract("path", r"grp=(\d+)", 1).cast("long")
    m = f.select(grp.alias("grp"), F.element_at(F.split("path", "/"), -1).alias("name"), F.when(grp % 3 != 0, F.upper(F.sha2("content", 256))).otherwise("00").alias("sha256"))
    paths = m.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    unique = m.join(paths, "name").withColumn("key", F.concat_ws("/", F.concat(F.lit("grp="), F.col("grp").cast("string")), F.col("name")))
    return FS.sha256_check(spark, path, unique, "key", "sha256", depth=2).groupBy("grp").agg(F.bool_and("sha256_valid").alias("sha256_valid"))


@query("tail_append_source", sql="SELECT user_id, event_id, value FROM events")
def q_tail(spark, sf):
    src, out, state = (scratch_path(spark, n) for n in ("tail-in", "tail-out", "tail-state"))
    table(spark, sf, "events").select("user_id", "event_id", "value").write.option("header", True).csv(src)
    q = SS.tail_csv(spark, src, "user_id long, event_id long, value double").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_id", "value")


@query("sink_tables", sql="SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def q_sink(spark, sf):
    path = scratch_path(spark, "sink")
    SK.write_stage(table(spark, sf, "events").select("event_type", "event_id", "value"), path, ["event_type"], raw=True)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def sound_trials(trial):
    """Trials recorded without faults: every fourth."""
    return trial % 4 == 0


def trial_streams(spark, sf):
    """Six-axis streams of trials. Those of sound trials tick at their configured rate, up to 2 ms late, and every sixteenth device of theirs
    loses sequence numbers; the others have the faults of ``strict_stream``."""
    c = F.col
    sound = sound_trials(F.floor(c("device") / 2))
    s = strict_stream(spark, sf, AXES, sound).withColumn("rate", F.when(c("device") % 4 == 0, 60.0).otherwise(50.0))
    tick = c("idx") * F.bround(1e9 / c("rate"), 0).cast("long") + c("idx") % 3 * 1000000
    return s.withColumns({"ns": F.when(sound, tick).otherwise(c("ns")), "seq": F.when(sound & (c("device") % 16 == 9) & (c("gz") == 60), (c("idx") + 1) % 65536).otherwise(c("seq"))})


def trial_labels(spark, sf):
    """Label documents; two of three sound trials have one without errors."""
    k = F.col("doc_id")
    fine = sound_trials(k) & (k % 3 != 2)
    good = {"schema_version": F.lit("2.0"), "taxonomy_version": F.lit("t1"), "annotation_scope": F.lit("full_recording"), "recording_duration_s": F.lit(120.0), "evidence_tier": F.lit("gold")}
    d = label_docs(spark, sf).withColumns({n: F.when(fine, v).otherwise(F.col(n)) for n, v in good.items()})
    d = d.withColumn("segments", F.filter("segments", lambda s: ~fine))
    return d.withColumn("errors", L.label_errors(ACTIVITY_IDS))


@query("training_captures_write")
def q_captures(spark, sf):
    """Stream reports and labels -> audit of the trials -> SI units and the configured rate for streams without issues of trials that passed -> captures."""
    c = F.col
    s = staged(trial_streams(spark, sf), "strict")
    sound = sound_trials(F.floor(c("device") / 2))
    wide = lambda most, narrow: F.when(sound, most).otherwise(narrow)
    report = staged(Q.stream_quality(s, DEV, "idx", "ns", "seq", AXES[:3], AXES[3:], c("rate"), wide(16.0, 0.96), wide(2000.0, 200.0)), "reports")
    rep = staged(trial_reports(spark, sf, report, trial_labels(spark, sf)), "trials")
    return accepted_captures(s, report, rep, scratch_path(spark, "captures"))


def accepted_captures(streams, report, trials, path):
    """Captures of the streams without an issue whose trial need not be recollected, in SI units at their configured rate."""
    c = F.col
    usable = report.filter(F.size("issues") == 0).withColumn("trial", F.floor(c("device") / 2))
    usable = usable.join(trials.filter("status <> 'recollect_required'").select("trial"), "trial", "left_semi").select("device")
    ordered = TA.to_si_units(spread_join(streams, usable, DEV, "inner"), AXES[:3], AXES[3:], F.lit("g"), F.lit("deg/s"), [F.lit(1.0)] * 3)
    grid = R.resample_ns(ordered, DEV, "idx", "ns", AXES, c("rate")).withColumnRenamed("ns", "timestamp_monotonic_ns").withColumn("trial", F.floor(c("device") / 2))
    return SK.write_captures(grid, trials, "trial", "device", path)


@query("build_feature_dataset")
def q_dataset(spark, sf):
    """gate -> impute -> resample -> segment windows -> features -> cap."""
    c = F.col
    x = staged(imu6(spark, sf).select("device", "idx", "t", *AXES, "roll"), "raw")
    seg = segments6_of(x)
    rec = x.groupBy("device").agg(F.max("t").alias("duration_s")).withColumns({"label_trainable": c("device") % 9 != 0, "evidence_tier": F.lit("gold")})
    iv = seg.withColumns({"window_trainable": c("device") % 9 != 0, "phase": F.lit("active"), "wear_state": F.lit("valid"), "tier": F.lit("gold")})
    eligible, _ = Q.trainability_gate(iv, rec, DEV, min_seconds=2.0)
    holes = x.withColumn("ax", F.when(c("idx") % 29 != 3, c("ax")))
    filled = staged(C.impute_linear_all(holes, DEV, "idx", ["ax"]), "filled")
    grid = R.uniform_resample(filled, DEV, "idx", "t", AXES, 50.0).withColumnRenamed("k", "idx")  # up to each device's duration, its last time
    e = segment_windows(grid, staged(eligible.select("device", "segment_id", "start_s", "end_s", "activity", "motion_state"), "intervals"), 50.0, 100, 50)
    f = dataset_features(e, 100)
    n = f.groupBy("device").agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_rows(f, DEV, ["segment_id", "win"], F.floor(c("segment_id") / 1024), "_rank")
    kept = spread_join(ranked, n, DEV).filter(WN.keep_linspace(c("_rank"), c("_n"), 300))
    return kept.select("device", "segment_id", "win", F.round(c("start_s") + c("win") * 50 / 50.0, 3).alias("window_start_s"), "activity", "motion_state", F.lit("2.0").alias("label_schema_version"),
                       *[r(c(k)).alias(k) for k in ("acc_mag_mean", "acc_mag_std", "gyro_mag_mean", "acc_sma")])


def dataset_features(e, n):
    """Second-generation features of segment windows."""
    from pyspark.sql import Window as W

    from ..functions import scalar as S

    by = ["device", "segment_id", "_wb", "win", "start_s", "activity", "motion_state"]
    d = e.select(*by, "idx", *[F.col(v).alias(k) for k, v in MAP.items()]).withColumns({"acc_mag": S.norm(*[F.col(c) for c in WN.AXES[:3]]), "gyro_mag": S.norm(*[F.col(c) for c in WN.AXES[3:]])})
    w = W.partitionBy(*by).orderBy("idx")
    d = d.withColumns({f"_p_{c}": F.lag(c).over(w) for c in WN.AXES + ["acc_mag", "gyro_mag"]})
    return WN._aggregate_v2(d, by, "idx", 50.0, n)


#: Rows of one held pose (4 s) in the posture captures.
POSE_ROWS = 200


def posture_captures(spark, sf):
    """imu6 as captures of a head that holds a pose for four seconds each, and the segments of their label documents.

    Motion is a twentieth, dynamic acceleration a tenth and scatter of the angles a thirtieth of the raw columns (a sitting person);
    devices by eleven keep moving, devices by five hardly turn.
    """
    c = F.col
    pose = lambda segment: F.pmod(c("device") * 3 + segment, F.lit(7))
    x = imu6(spark, sf).withColumns({"segment_id": F.floor(c("idx") / POSE_ROWS)}).withColumn("_p", pose(c("segment_id")))
    calm = F.when(c("device") % 11 == 0, 4.0).otherwise(20.0)
    held = {"roll": F.when(c("_p") == 1, 20.0).when(c("_p") == 3, -20.0), "pitch": F.when(c("_p").isin(1, 5), -25.0).when(c("_p") == 2, 25.0),
            "yaw": F.when(c("_p").isin(2, 4), F.when(c("device") % 5 == 0, 6.0).otherwise(30.0))}
    x = x.withColumns({"ax": c("ax") / 10, "ay": c("ay") / 10, "az": 1 + (c("az") - 1) / 10, **{g: c(g) / calm for g in AXES[3:]},
                       **{a: F.coalesce(h, F.lit(0.0)) + c(a) / 30 for a, h in held.items()}}).drop("_p")
    samples = staged(with_quats(x), "posture")
    rec = samples.groupBy("device").agg(F.max("idx").alias("_last"), F.max("t").alias("duration_s"))
    seg = R.explode_range(rec, F.lit(0), F.floor(c("_last") / POSE_ROWS), "segment_id").drop("_last").withColumn("_p", pose(c("segment_id")))
    p = c("_p")
    deviations = (F.when(p == 1, F.array(F.lit("head_tilt_left"), F.lit("head_down"))).when(p == 2, F.array(F.lit("head_up"), F.lit("head_turn_left"))).when(p == 3, F.array(F.lit("head_tilt_right")))
                  .when(p == 4, F.array(F.lit("head_turn_left"))).when(p == 5, F.array(F.lit("forward_head_candidate"), F.lit("head_down"))).otherwise(F.array().cast("array<string>")))
    start = c("segment_id") * (POSE_ROWS / 50.0)
    seg = seg.withColumns({"start_s": start + c("segment_id") % 3 / 100, "end_s": start + POSE_ROWS / 50.0 - c("segment_id") % 2 / 10, "posture_state": F.when(p.isin(0, 6), "normal").otherwise("poor"), "deviations": deviations,
                           "reference_source": F.when(c("device") % 2 == 1, "video_review"), "window_trainable": c("segment_id") % 10 != 9, "evidence_tier": F.when(c("device") % 4 == 0, "legacy_reviewed").otherwise("gold")})
    return samples, seg.drop("_p")


@query("build_posture_dataset")
def q_posture_dataset(spark, sf):
    """segments -> neutral baseline of the normal ones -> windows of each segment -> cap -> stability gate; kind ``manifest``: one row per segment."""
    samples, segments = posture_captures(spark, sf)
    return posture_dataset(samples, segments)


def posture_dataset(samples, segments, cap=160):
    """Windows of stable poses and the manifest. A segment lies in the ``POSE_ROWS`` rows of its number."""
    c = F.col
    n, step = WN.window_rows(3.0, 50.0), WN.step_by_hop(0.5, 50.0)
    seg = P.posture_segments(segments).withColumns({"start_s": F.greatest(F.lit(0.0), c("start_s")), "end_s": F.least(c("duration_s"), c("end_s"))})
    seg = staged(seg.select("device", "segment_id", "label", "evidence_tier", "duration_s", F.floor(c("start_s") * 50.0).alias("_lo"), F.floor(c("end_s") * 50.0).alias("_hi"), F.ceil(c("start_s") * 50.0).alias("_first")), "segments")
    normal = samples.join(seg.filter("label = 'normal'").select("device", "segment_id", "_lo", "_hi"), ["device", "segment_id"]).filter((c("idx") >= c("_lo")) & (c("idx") < c("_hi")))
    base = P.neutral_baseline(P.middle_of_segments(normal, "idx", c("_lo"), c("_hi")), DEV, ["ax", "ay", "az"], ["roll", "pitch", "yaw"], ["q0", "q1", "q2", "q3"])
    manifest = staged(J.baseline_join(seg, base, DEV, "base_ax"), "manifest")
    known = manifest.filter("included")
    ref = {**{a: c(f"base_{a}") for a in ("ax", "ay", "az", "roll", "pitch", "yaw")}, **{f"q{i}": F.get("base_quat", F.lit(i)) for i in range(4)}}
    j = samples.join(known.select("device", "segment_id", "_first", "_hi", *[f"base_{a}" for a in ("ax", "ay", "az", "roll", "pitch", "yaw", "quat")]), ["device", "segment_id"])
    j = j.filter((c("idx") >= c("_first")) & (c("idx") < c("_hi"))).withColumn("idx", c("idx") - c("_first"))
    w = P.posture_windows(j, ["device", "segment_id"], "idx", ref).join(known.drop(*base.columns[1:]), ["device", "segment_id"])
    starts = F.ceil((c("_hi") - c("_first") - n + 1) / step)
    stable = Q.stable_pose(c("gyro_mean_dps"), c("dynamic_acc_std_g"), c("rotation_degrees_mean"), c("label"))
    w = w.filter(WN.keep_linspace(c("win"), starts, cap)).filter(stable)
    windows = w.select(F.lit("window").alias("kind"), "device", "segment_id", "win", F.round((c("_first") + c("win") * step) / 50.0, 3).alias("window_start_s"), c("label").alias("posture"), "evidence_tier",
                       *[r(c(k), 4).alias(k) for k in ("rotation_degrees_mean", "gravity_change_degrees", "gyro_mean_dps", "dynamic_acc_std_g")])
    listed = manifest.select(F.lit("manifest").alias("kind"), "device", "segment_id", c("label").alias("posture"), "evidence_tier", F.round("duration_s", 3).alias("duration_s"), "included", "excluded_reason")
    return windows.unionByName(listed, allowMissingColumns=True)
