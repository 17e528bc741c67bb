"""File sources: vendor logs, strict trials, manifests, labels, notes, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ["时间", "设备名称", "片上时间()", "版本号()"]  # fixed vendor names that stay text
STRICT = ["timestamp_monotonic_ns", "sequence_id", "ear_side", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
STRICT_SCHEMA = T.StructType([T.StructField(c, T.LongType() if i < 2 else T.StringType() if i == 2 else T.DoubleType()) for i, c in enumerate(STRICT)])
TIMELINE_DEFAULTS = {"set_id": "", "motion_state": None, "wear_state": "valid", "phase": None, "window_trainable": "true", "label_source": "", "confidence": "", "evidence_tier": "rejected"}
STREAM = ("device_id string, ear_side string, csv_file string, sha256 string, sample_rate_configured_hz double, acceleration_unit string, angular_velocity_unit string, "
          "acceleration_range double, angular_velocity_range double, filter_config string, firmware_version string, axis_sign array<int>")
MANIFEST = ("schema_version string, protocol_version string, date string, session_id string, subject_id string, collector_id string, app_version string, "
            f"trials array<struct<trial_id: string, label_file: string, streams: array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in STREAM.split(', '))}>>>>")
SEGMENT = ("start_s: double, end_s: double, activity_id: string, motion_state: string, wear_state: string, phase: string, window_trainable: boolean, label_source: string, confidence: string, "
           "posture_state: string, deviations: array<string>, reference_source: string, label: string")
LABEL_DOC = ("schema_version string, taxonomy_version string, date string, participant string, device string, csv_file string, annotation_scope string, raw_action string, "
             f"recording struct<duration_seconds: double, start_time: string, end_time: string>, window_trainable boolean, annotation_quality string, evidence_tier string, segments array<struct<{SEGMENT}>>")


def _read_log(spark: SparkSession, path: str, sep: str) -> DataFrame:
    raw = (spark.read.option("header", True).option("sep", sep).option("recursiveFileLookup", True).option("ignoreLeadingWhiteSpace", True)
           .option("mode", "PERMISSIVE").csv(path))
    names = [c.strip().lstrip("﻿").strip() for c in raw.columns]
    source = F.col("_metadata.file_path")
    kept = [(i, n) for i, n in enumerate(names) if not n.startswith(("Unnamed", "_c"))]
    cols = []
    for i, n in kept:
        text = F.col(f"`{raw.columns[i]}`")
        cols.append((F.trim(text) if n in TEXT_COLUMNS or n.startswith("_") else F.trim(text).try_cast("double")).alias(n))
    return raw.select(*cols, source.alias("_file"))


def scan_logger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vendor CSV logs: BOM, padded headers and one surplus trailing field per row are tolerated."""
    return _read_log(spark, path, ",")


def scan_logger_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _read_log(spark, path, "\t")


def natural_key(path: Column) -> Column:
    """Sort key where digit runs compare as numbers."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(F.length(F.regexp_replace(p, "^0+(?=.)", "")).cast("string"), 4, "0"),
                                                                                 F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "\u0001")


def discover_captures(spark: SparkSession, path: str) -> DataFrame:
    """csv and txt captures below a folder, with sizes, in natural order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    found = files.filter(F.lower("path").rlike(r"\.(csv|txt)$"))
    return found.withColumn("natural", natural_key(F.col("path"))).orderBy("natural")


def path_metadata(df: DataFrame, path: str) -> DataFrame:
    """Activity folder, trial, subject pair, session, device, format and recording from a path; nearest ancestor first."""
    c = F.col
    parts = F.split(F.translate(c(path), "\\", "/"), "/")
    up = F.reverse(F.slice(parts, 1, F.size(parts) - 1))
    name = F.element_at(parts, -1)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    pair = r"^([\x{4e00}-\x{9fff}]{2,4}\+[\x{4e00}-\x{9fff}]{2,4})"
    first = lambda test: F.get(F.filter(up, test), F.lit(0))
    plus = first(lambda p: p.contains("+"))
    source = F.coalesce(plus, F.when(ext == "txt", stem).otherwise(F.get(up, F.lit(0))))
    act = F.regexp_replace(source, r"(?i)__(csv|txt)$", "")
    act = F.regexp_replace(act, r"^[\x{4e00}-\x{9fff}]{2,4}\+[\x{4e00}-\x{9fff}]{2,4}\s*-?\s*", "")
    act = F.trim(F.regexp_replace(F.trim(F.regexp_replace(act, r"\s*\(\d+\)\s*", " ")), r"\s+", " "))
    # fixed name rules
    activity = (F.when(act.startswith("坐起"), "坐下起立").when(act.startswith("站姿"), "站立").when(act.startswith("走路") & act.contains("3.0"), "慢走")
                .when(act.startswith("走路") & act.contains("5.0"), "快走").when(act.isin("自由走路", "自由行走"), "自由行走").otherwise(act))
    trial = F.coalesce(F.regexp_extract(source, r"\((\d+)\)", 1).try_cast("int"), F.lit(1))
    mac = F.regexp_extract(stem, r"\(([0-9a-fA-F-]{17})\)", 1)
    device = F.when(mac != "", F.lower(mac)).otherwise(F.regexp_extract(F.regexp_replace(stem, "^_+", ""), r"^([^(]*)", 1))
    session = F.coalesce(first(lambda p: p.rlike(r"^\d{2}-\d{2}-\d{2}-\d{3}$")), F.lit("unknown-session"))
    subject = F.coalesce(F.regexp_extract(first(lambda p: p.rlike(pair)), pair, 1), F.lit("unknown"))
    d = df.withColumns({"source_name": source, "activity": activity, "trial": trial, "subject_group": subject, "session_name": session, "device_id": device, "source_format": ext, "_plus": plus})
    rec = F.when(c("source_name").rlike(r"(?i)__(csv|txt)$"), c("source_name")).when(c("_plus").isNotNull(), F.concat_ws("__", "activity", "session_name", "device_id", "source_format")).otherwise(
        F.concat_ws("__", "source_name", "source_format"))
    return d.withColumn("recording", rec).drop("_plus")


def capture_identity(stem: Column) -> tuple[Column, Column, Column]:
    """date, subject, raw action of ``date-subject-action``; a missing date or subject is named unknown."""
    p = F.split(stem, "-", 3)
    dated = (F.size(p) == 3) & F.get(p, F.lit(0)).rlike(r"^\d{4}$")
    two = F.size(p) >= 2
    rest = F.array_join(F.slice(p, 2, 3), "-")
    return (F.when(dated, F.get(p, F.lit(0))).otherwise("unknown-date"), F.when(dated, F.get(p, F.lit(1))).when(two, F.get(p, F.lit(0))).otherwise("unknown-subject"),
            F.when(dated, F.get(p, F.lit(2))).when(two, rest).otherwise(stem))


def scan_strict(spark: SparkSession, path: str) -> DataFrame:
    """Trial streams with the nine required columns; anything unreadable fails the job."""
    header = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).columns
    missing = sorted(set(STRICT) - set(header))
    if missing:
        raise ValueError(f"CSV missing columns: {missing}")
    types = {f.name: f.dataType for f in STRICT_SCHEMA}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path).select(*STRICT, F.col("_metadata.file_path").alias("_file"))


def scan_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per (session, trial, stream) with the array ``errors`` of broken rules.

    ``multi_line`` is for one document per file; without it every line is a document and files split.
    """
    m = spark.read.schema(MANIFEST).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    need = ["schema_version", "protocol_version", "date", "session_id", "subject_id", "collector_id", "app_version", "trials"]
    c = F.col
    ids = F.transform("trials", lambda t: t["trial_id"])
    m = m.withColumn("_ids", ids)
    t = m.select("*", F.explode("trials").alias("_t"))
    dup_trial = F.size(F.filter("_ids", lambda i: i == c("_t.trial_id"))) > 1
    who = F.transform("_t.streams", lambda s: F.concat_ws("|", s["device_id"], s["ear_side"]))
    dup_stream = F.size(F.array_distinct(who)) < F.size(who)
    gone = F.array_compact(F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in need]))
    fields = [f.strip().split(" ")[0] for f in STREAM.split(", ") if not f.strip().startswith("axis_sign")]
    t = t.select("*", F.explode_outer("_t.streams").alias("_s"))
    lost = F.array_compact(F.array(*[F.when(c(f"_s.{f}").isNull(), F.lit(f)) for f in fields]))
    tests = [(F.size(gone) > 0, F.concat(F.lit("session_manifest missing "), F.concat_ws(",", gone))), (F.coalesce(c("schema_version") != "1.0", F.lit(True)), F.lit("schema_version must be 1.0")),
             (dup_trial, F.lit("trial_id must occur exactly once")), (c("_t.label_file").isNull(), F.lit("trial missing label_file")), (dup_stream, F.lit("duplicate device stream")),
             (F.size(lost) > 0, F.concat(F.lit("device stream missing "), F.concat_ws(",", lost)))]
    return t.withColumn("errors", F.array_compact(F.array(*[F.when(x, y) for x, y in tests]))).select(
        "session_id", "subject_id", "date", c("_t.trial_id").alias("trial_id"), c("_t.label_file").alias("label_file"), "_s.*", "errors").withColumn(
        "axis_sign", F.coalesce("axis_sign", F.array(F.lit(1), F.lit(1), F.lit(1))))


def scan_label_docs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Label documents; v2 rows are ready for ``label_errors``, others are marked legacy."""
    d = spark.read.schema(LABEL_DOC).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    return d.withColumns({"recording_duration_s": F.col("recording.duration_seconds"), "legacy": F.coalesce(F.col("schema_version") != "2.0", F.lit(True)), "_file": F.col("_metadata.file_path"),
                          "segments": F.coalesce("segments", F.array().cast(d.schema["segments"].dataType))})


def scan_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline rows: action_id is accepted for activity_id, absent columns get defaults, source_file loses its folder."""
    d = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    names = {c: c.strip().lstrip("﻿") for c in d.columns}
    d = d.withColumnsRenamed(names)
    if "activity_id" not in d.columns and "action_id" in d.columns:
        d = d.withColumnRenamed("action_id", "activity_id")
    missing = sorted({"source_file", "start_s", "end_s", "activity_id", "phase"} - set(d.columns))
    if missing:
        raise ValueError(f"timeline is missing columns: {missing}")
    col = lambda n, v: F.col(n) if n in d.columns else F.lit(v).cast("string")
    return d.select(F.regexp_extract("source_file", r"([^/\\]*)$", 1).alias("source_file"), F.col("start_s").try_cast("double").alias("start_s"), F.col("end_s").try_cast("double").alias("end_s"),
                    "activity_id", *[(col(n, v).cast("boolean") if n == "window_trainable" else col(n, v)).alias(n) for n, v in TIMELINE_DEFAULTS.items()])


def scan_notes(spark: SparkSession, path: str, limit: int | None = None, device_terms: tuple[str, ...] = ("WT901", "WT22222")) -> DataFrame:
    """Note files as text: UTF-8, else GB18030; device logs are left out.

    A file above ``limit`` bytes keeps its row, without content and with the reason ``too_large``.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    for t in device_terms:
        f = f.filter(~F.element_at(F.split("path", "/"), -1).contains(t))
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = F.trim(F.regexp_replace(F.coalesce(utf8, F.decode("content", "GB18030")), "^﻿", ""))
    large = F.col("length") > limit if limit is not None else F.lit(False)
    return f.select("path", F.when(~large, text).alias("content"), F.when(large, "too_large").alias("reason"))


def sha256_check(spark: SparkSession, path: str, manifest: DataFrame, name: str, digest: str, depth: int = 1) -> DataFrame:
    """Checksum of each file against the manifest, by the last ``depth`` parts of the path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    f = f.select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias(name), F.sha2("content", 256).alias("_have"))
    return manifest.join(f, name, "left").withColumn("sha256_valid", F.coalesce(F.col("_have") == F.lower(F.col(digest)), F.lit(False))).drop("_have")
