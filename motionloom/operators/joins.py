"""Interval, as-of, dictionary and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .ordered import spread_join

PAIR_SHARDS = 8


def interval_join(points: DataFrame, intervals: DataFrame, key: list[str], at: str, lo: str, hi: str, width: float,
                  closed: Column | None = None) -> DataFrame:
    """Points with every interval of their key that holds them (lo <= at < hi, or <= hi where ``closed``).

    Both sides meet in buckets of ``width`` on the point axis, so a key with many points and many
    intervals becomes many small equi-joins instead of one quadratic one.
    """
    last = F.floor(F.col(hi) / width)
    iv = intervals.withColumn("_bkt", F.explode(F.sequence(F.floor(F.col(lo) / width), F.greatest(last, F.floor(F.col(lo) / width)))))
    p = points.withColumn("_bkt", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(lo)) & ((F.col(at) < F.col(hi)) | ((closed & (F.col(at) == F.col(hi))) if closed is not None else F.lit(False)))
    return p.join(iv, [*key, "_bkt"]).filter(inside).drop("_bkt")


def segment_assign(rows: DataFrame, segments: DataFrame, key: list[str], at: str, row: str, seg: str, lo: str, hi: str, width: float) -> DataFrame:
    """start_row, end_row and row_count of every segment; a key's last segment includes its end."""
    last = segments.groupBy(*key).agg(F.max(lo).alias("_last"))
    s = segments.join(last, key).withColumn("_closed", F.col(lo) == F.col("_last")).drop("_last")
    hits = interval_join(rows.select(*key, at, row), s.select(*key, seg, lo, hi, "_closed"), key, at, lo, hi, width, F.col("_closed"))
    g = hits.groupBy(*key, seg).agg(F.min(row).alias("start_row"), F.max(row).alias("end_row"), F.count(F.lit(1)).alias("row_count"))
    return segments.join(g, [*key, seg], "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def taxonomy_join(df: DataFrame, name: str, reviewed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Whole-string lookup after removing white space; excluded names are known but not trainable.

    The dictionaries are plain equi-joins: Spark broadcasts them when their size allows it.
    """
    d = df.withColumn("_n", F.regexp_replace(F.col(name), r"\s+", ""))
    d = d.join(reviewed.select(F.col("raw_name").alias("_n"), "activity_id", "phase", "trainable"), "_n", "left")
    d = d.join(excluded.select(F.col("raw_name").alias("_n"), "reason"), "_n", "left")
    out = F.col("reason").isNotNull()
    usable = F.coalesce(F.col("trainable"), F.lit(False)) & ~out
    return d.withColumns({"activity_id": F.when(usable, F.col("activity_id")), "usable": usable,
                          "phase": F.when(out | F.col("phase").isNull(), "transition").otherwise(F.col("phase"))}).drop("_n", "trainable", "reason")


def contains_first(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """Value of the first dictionary term (by ``ordinal``) that the text contains; NULL without one.

    The text's substrings as long as the shortest term meet the terms' beginnings by equality, for a
    dictionary of any size; each candidate carries as many characters as the longest term has, which decide.
    One pattern takes those that start with some term's first letter in a single pass, so the work is linear in the text's length.
    Rows meet their answer by a digest of the text, so rows that share other columns are answered alone.
    """
    terms = terms.filter("ordinal IS NOT NULL").withColumn("_one", F.lit(0))
    bounds = terms.groupBy("_one").agg(F.min(F.length("term")).alias("_short"), F.max(F.length("term")).alias("_long"))
    t = spread_join(terms, bounds, ["_one"], "inner").withColumn("_begin", F.substring(F.col("term"), F.lit(1), F.col("_short")))
    t = staged(t.orderBy("ordinal").withColumn("_id", F.monotonically_increasing_id()), "terms")  # in files Spark knows its size
    d = df.withColumn("_digest", F.md5(text))
    texts = d.filter("_digest IS NOT NULL").select("_digest", F.col(text).alias("_text"), F.lit(0).alias("_one")).repartition("_digest")  # however few files hold them
    letter = F.concat(F.lit("\\x{"), F.hex(F.ascii("term")), F.lit("}"))  # a text has candidates only where some term's first letter stands
    b = spread_join(texts, t.groupBy("_one").agg(F.max("_short").alias("_short"), F.max("_long").alias("_long"), F.concat_ws("", F.collect_set(letter)).alias("_letters")), ["_one"], "inner")
    begins_here = F.format_string("(?s)(?=(.{1,%d}))[%s]", F.greatest(F.col("_long"), F.lit(1)), F.col("_letters"))
    parts = F.concat(F.regexp_extract_all("_text", begins_here, F.lit(1)), F.array(F.lit("")))
    g = b.select("_digest", "_short", F.explode(parts).alias("_part")).withColumn("_begin", F.substring(F.col("_part"), F.lit(1), F.col("_short")))
    hit = g.join(t.select("_id", "term", "_begin"), "_begin").filter(F.startswith("_part", "term"))
    first = hit.groupBy("_digest").agg(F.min("_id").alias("_id")).join(t.select("_id", "value"), "_id")
    return d.join(first.drop("_id"), "_digest", "left").drop("_digest")


def dual_stream_pair(df: DataFrame, trial: str, side: str, start_ns: str) -> DataFrame:
    """Both sides present, start offset in ms, a note above 100 ms and hard above 500 ms."""
    has = lambda s: F.max((F.col(side) == s).cast("int")) == 1
    g = df.groupBy(trial).agg(F.count(F.lit(1)).alias("streams"), has("left").alias("_l"), has("right").alias("_r"),
                              ((F.max(start_ns) - F.min(start_ns)) / 1e6).alias("_off"))
    both = F.col("streams") == 2
    off = F.when(both, F.col("_off"))
    return g.select(trial, "streams", (F.col("_l") & F.col("_r")).alias("pair_complete"), off.alias("offset_ms"),
                    F.coalesce(off > 100, F.lit(False)).alias("note"), (~both | ~(F.col("_l") & F.col("_r")) | F.coalesce(off > 500, F.lit(False))).alias("hard"))


def baseline_join(windows: DataFrame, baseline: DataFrame, key: list[str], marker: str) -> DataFrame:
    j = spread_join(windows, baseline, key)
    found = F.col(marker).isNotNull()
    return j.withColumns({"included": found, "excluded_reason": F.when(found, "").otherwise("missing_normal_seated_baseline")})


def reconcile(recordings: DataFrame, labels: DataFrame, id_: str) -> DataFrame:
    """Rows (kind, id): missing labels, orphan labels, duplicate labels; and the inventory size."""
    r = recordings.groupBy(id_).agg(F.lit(1).alias("_r"))
    l = labels.groupBy(id_).agg(F.count(F.lit(1)).alias("_l"))
    both = r.join(l, id_, "full")
    kinds = F.array_compact(F.array(F.when(F.col("_l").isNull(), "missing_label"), F.when(F.col("_r").isNull(), "orphan_label"), F.when(F.col("_l") > 1, "duplicate_label")))
    found = both.select(F.explode(kinds).alias("kind"), F.col(id_).cast("long").alias("id"))
    return found.unionByName(both.agg(F.count(F.lit(1)).alias("id")).select(F.lit("inventory").alias("kind"), "id"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")


def override_join(captures: DataFrame, overrides: DataFrame, path: str) -> DataFrame:
    """A reviewed override by normalised relative path replaces the activity."""
    d = captures.withColumn("_p", normal_path(F.col(path)))
    o = overrides.select(F.col("path").alias("_p"), F.col("activity").alias("_a"), "decision", "reason")
    return d.join(o, "_p", "left").withColumn("activity", F.coalesce("_a", "activity")).drop("_p", "_a")


def inherit_split(sessions: DataFrame, splits: DataFrame, subject: str) -> DataFrame:
    known = splits.groupBy(subject).agg(F.max("split").alias("split"))
    s = spread_join(sessions, known, [subject], large=True).withColumn("split", F.coalesce("split", F.lit("unassigned")))
    return s.withColumn("formal_evaluation", F.col("split").isin("validation", "test"))


def class_pairs(classes: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """All unordered pairs of class rows (a vocabulary table). An equi-join on shard cells spreads the work."""
    shard = F.pmod(F.xxhash64(name), F.lit(PAIR_SHARDS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PAIR_SHARDS - 1)))
    a = classes.select(F.col(name).alias(f"{name}_a"), *[F.col(c).alias(f"{c}_a") for c in columns], shard.alias("_s"), every.alias("_t"))
    b = classes.select(F.col(name).alias(f"{name}_b"), *[F.col(c).alias(f"{c}_b") for c in columns], every.alias("_s"), shard.alias("_t"))
    return a.join(b, ["_s", "_t"]).filter(F.col(f"{name}_a") < F.col(f"{name}_b")).drop("_s", "_t")


def device_set_match(labels: DataFrame, manifest: DataFrame, trial: str, device: str) -> DataFrame:
    """Label devices equal manifest devices, per trial, without collecting sets."""
    one = lambda d, n: d.groupBy(trial, device).agg(F.lit(True).alias(n))
    j = one(labels, "_l").join(one(manifest, "_m"), [trial, device], "full")
    return j.groupBy(trial).agg(F.bool_and(F.col("_l").isNotNull() & F.col("_m").isNotNull()).alias("match"))
