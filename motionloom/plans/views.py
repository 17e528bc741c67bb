"""Views that present the driver's tables as sensor data, for the queries and their SQL twins."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import number_rows

IMU_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURES = [f"f{i}" for i in range(64)]
SCORES = ["s0", "s1", "s2", "s3"]
AXES = ["ax", "ay", "az", "gx", "gy", "gz"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; zone-less timestamps become instants in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    zoneless = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless}) if zoneless else df


def imu6(spark: SparkSession, sf: str) -> DataFrame:
    """Per-device six-axis capture with Euler angles on a 50 Hz axis, from lineitem."""
    li = table(spark, sf, "lineitem").select("l_suppkey", *IMU_ORDER)
    # quarters hold many rows of a device, days hardly one; rows without a device are numbered day by day
    block = F.when(F.col("l_suppkey").isNull(), F.col("l_shipdate")).otherwise(F.date_trunc("quarter", "l_shipdate"))
    rows = number_rows(li, ["l_suppkey"], IMU_ORDER, block)
    order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    return rows.select(
        F.col("l_suppkey").alias("device"), "idx", (F.col("idx") / F.lit(50.0)).alias("t"),
        ((F.col("l_quantity") - 25) / 25).alias("ax"), ((F.col("l_discount") - 0.05) * 10).alias("ay"),
        (1 + (F.col("l_tax") - 0.04) * 5).alias("az"), (part % 401 - 200).cast("double").alias("gx"),
        (order % 301 - 150).cast("double").alias("gy"), ((line - 4) * 20).cast("double").alias("gz"),
        (order % 361 - 180).cast("double").alias("roll"), (part % 181 - 90).cast("double").alias("pitch"),
        ((order % 719).cast("double") / 2 - 180).alias("yaw"))


def _numbered_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return number_rows(ev, ["user_id"], ["ts", "event_id"], F.date_trunc("minute", "ts"))


def stream1(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular one-channel stream with NULLs, zero dropouts and sequence ids, from events."""
    e = F.col("event_id")
    return _numbered_events(spark, sf).select(
        F.col("user_id").alias("device"), e.alias("row_id"), "ts", "idx",
        F.when(e % 7 == 0, None).when(e % 11 == 0, 0.0).otherwise(F.col("value")).alias("x"),
        F.col("event_type").alias("channel"), (e % 65536).alias("sequence_id"))


def stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``stream1`` without the position, for work that does not need it (no shuffle)."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("device"), e.alias("row_id"), "ts",
        F.when(e % 7 == 0, None).when(e % 11 == 0, 0.0).otherwise(F.col("value")).alias("x"),
        F.col("event_type").alias("channel"), (e % 65536).alias("sequence_id"))


def windows1(spark: SparkSession, sf: str) -> DataFrame:
    """Per-window motion probabilities on a 1 s hop, from events."""
    p = (F.col("event_id") * 37) % 100
    return _numbered_events(spark, sf).select(
        F.col("user_id").alias("device"), F.col("idx").alias("t"), (p.cast("double") / 100).alias("p_motion"),
        F.when(p >= 50, "motion").otherwise("non_motion").alias("label"))


def segments1(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled intervals, from events."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("device"), F.col("event_id").alias("segment_id"), F.col("event_type").alias("activity"),
        F.unix_micros("ts").alias("start_us"), F.col("value").alias("duration_s"))


def segments6(spark: SparkSession, sf: str) -> DataFrame:
    """One labelled interval per device and 3 s of ``imu6`` with gaps between, from the samples."""
    return segments6_of(imu6(spark, sf))


def segments6_of(samples: DataFrame) -> DataFrame:
    b = F.floor(F.col("idx") / 150).alias("segment_id")
    g = samples.groupBy("device", b).agg(F.min("gx").alias("g"), F.min("gz").alias("z"), F.max("roll").alias("r"))
    return g.select(
        "device", "segment_id", (F.col("segment_id") * 3 + F.abs(F.col("g")) / 400).alias("start_s"),
        (F.col("segment_id") * 3 + 2.2 + F.abs(F.col("r")) / 300).alias("end_s"),
        F.concat(F.lit("act"), (F.abs(F.col("g")) % 5).cast("int").cast("string")).alias("activity"),
        F.when(F.abs(F.col("g")) % 3 == 0, "non_motion").otherwise("motion").alias("motion_state"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Binary truth and score with group and dimension, from labels and documents."""
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    return l.join(d.select("doc_id", "n_chars", "source", "lang"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y2"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("score"), F.col("source").alias("grp"), F.col("lang").alias("dim"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature table with class, capture group, subject and four class scores (absolute sums of every fourth feature), from embeddings."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 10).alias("grp"), (F.col("vec_id") % 25).alias("subject"),
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])
    return rows.withColumns({s: F.abs(reduce(add, [F.col(f) for f in FEATURES[i::4]])) for i, s in enumerate(SCORES)})


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """One audited recording per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("recording"), F.concat_ws("-", c.cast("string"), F.year("o_orderdate").cast("string")).alias("capture_group"),
        (c % 10).alias("device_id"), F.col("o_orderpriority").alias("activity"),
        F.when(F.col("o_orderstatus") == "F", "csv").when(F.col("o_orderstatus") == "O", "txt").otherwise("bin").alias("source_format"),
        (F.col("o_totalprice") / 2000).alias("duration_s"), ((c % 7 + 1) * 50 * (F.lit(0.8) + (k % 5) / F.lit(10.0))).alias("sample_rate_hz"),
        (k % 1000 + 100).alias("rows"), ((k % 10) / F.lit(100.0)).alias("full_duplicate_ratio"), (k % 86400).cast("double").alias("start_second_of_day"),
        (k % 13 != 0).alias("orientation_valid"), F.when(k % 17 == 0, "q0;q1").otherwise("").alias("missing_core_columns"))


CTE = {
    "imu6": """SELECT l_suppkey AS device, idx, idx / CAST(50 AS DOUBLE) AS t,
  (l_quantity - 25) / 25 AS ax, (l_discount - CAST(0.05 AS DOUBLE)) * 10 AS ay, 1 + (l_tax - CAST(0.04 AS DOUBLE)) * 5 AS az,
  CAST(l_partkey % 401 - 200 AS DOUBLE) AS gx, CAST(l_orderkey % 301 - 150 AS DOUBLE) AS gy, CAST((l_linenumber - 4) * 20 AS DOUBLE) AS gz,
  CAST(l_orderkey % 361 - 180 AS DOUBLE) AS roll, CAST(l_partkey % 181 - 90 AS DOUBLE) AS pitch, CAST(l_orderkey % 719 AS DOUBLE) / 2 - 180 AS yaw
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
        l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx FROM lineitem) z""",
    "stream1": """SELECT user_id AS device, event_id AS row_id, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS x,
  event_type AS channel, event_id % 65536 AS sequence_id
FROM events""",
    "windows1": """SELECT user_id AS device, idx AS t, CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS p_motion,
  CASE WHEN (event_id * 37) % 100 >= 50 THEN 'motion' ELSE 'non_motion' END AS label
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) z""",
    "segments1": """SELECT user_id AS device, event_id AS segment_id, event_type AS activity, epoch_us(ts) AS start_us, value AS duration_s
FROM events""",
    "segments6": """SELECT device, segment_id, segment_id * 3 + abs(g) / 400 AS start_s, segment_id * 3 + CAST(2.2 AS DOUBLE) + abs(r) / 300 AS end_s,
  'act' || CAST(CAST(abs(g) % 5 AS INTEGER) AS VARCHAR) AS activity, CASE WHEN abs(g) % 3 = 0 THEN 'non_motion' ELSE 'motion' END AS motion_state
FROM (SELECT device, idx // 150 AS segment_id, min(gx) AS g, max(roll) AS r FROM imu6 GROUP BY 1, 2) z""",
    "recs": """SELECT o_orderkey AS recording, o_custkey || '-' || year(o_orderdate) AS capture_group, o_custkey % 10 AS device_id, o_orderpriority AS activity,
 CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN 'txt' ELSE 'bin' END AS source_format, o_totalprice / 2000 AS duration_s,
 (o_custkey % 7 + 1) * 50 * (CAST(0.8 AS DOUBLE) + (o_orderkey % 5) / CAST(10 AS DOUBLE)) AS sample_rate_hz, o_orderkey % 1000 + 100 AS rows,
 (o_orderkey % 10) / CAST(100 AS DOUBLE) AS full_duplicate_ratio, CAST(o_orderkey % 86400 AS DOUBLE) AS start_second_of_day,
 o_orderkey % 13 <> 0 AS orientation_valid, CASE WHEN o_orderkey % 17 = 0 THEN 'q0;q1' ELSE '' END AS missing_core_columns FROM orders""",
    "scores": """SELECT l.doc_id, l.quality AS y, l.toxic AS y2, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score, d.source AS grp, d.lang AS dim
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "features": "SELECT *, " + ", ".join(f"abs({' + '.join(FEATURES[i::4])}) AS {s}" for i, s in enumerate(SCORES)) + """
FROM (SELECT vec_id, label, vec_id % 10 AS grp, vec_id % 25 AS subject, """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURES)) + """
FROM embeddings) z""",
}
