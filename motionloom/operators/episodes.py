"""Sessions, episodes, debouncing, latest state and daily summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.taxonomy import CARDIO
from .ordered import BLOCK_ROWS, Scan, block_scan, index_block, islands, neighbours, spread_join


def latest_per_key(df: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """Last k rows per key. Spark limits each key to k rows before the shuffle."""
    w = W.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def sessionize_gap(df: DataFrame, key: list[str], order: str, start: str, end: str, prob: str, gap: float, block: Column) -> DataFrame:
    """Sessions of active windows: a new one when start minus the previous end exceeds ``gap``."""
    d = block_scan(df, key, [start, order], block, [Scan("_pe", F.col(end), "last", inclusive=False)])
    new = F.when(F.coalesce(F.col(start) - F.col("_pe") > gap, F.lit(True)), F.struct(F.col(start).alias("s"), F.col(order).alias("o")))
    d = block_scan(d.withColumn("_new", new), key, [start, order], block, [Scan("_sid", F.col("_new"), "last")])
    at = F.struct(start, order)
    g = d.groupBy(*key, "_sid").agg(F.min(start).alias("start_s"), F.max_by(end, at).alias("end_s"), F.avg(prob).alias("_p"), F.count(F.lit(1)).alias("windows"))
    return g.select(*key, "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), F.bround(F.col("_p") * 100, 0).alias("confidence"), "windows")


def debounce_count(df: DataFrame, key: list[str], idx: str, label: str, need: int = 3, size: int = BLOCK_ROWS) -> DataFrame:
    """Stable label: changes after ``need`` equal rows in a row; the first row sets it."""
    d = neighbours(df, key, idx, {"_prev": label}, size=size)
    d = islands(d, key, idx, F.col("_prev").isNull() | (F.col("_prev") != F.col(label)), "_run", size)
    sure = (F.col(idx) - F.col("_run") + 1 >= need) | (F.col(idx) == 0)
    d = d.withColumn("_sure", F.when(sure, F.col(label)))
    return block_scan(d, key, [idx], index_block(idx, size), [Scan("stable", F.col("_sure"), "last")]).drop("_prev", "_run", "_sure")


def debounce_hold(df: DataFrame, key: list[str], idx: str, t: str, label: str, on: float = 30.0, off: float = 5.0, normal: str = "normal",
                  size: int = BLOCK_ROWS) -> DataFrame:
    """Episodes of held labels: (label, started_at, ended_at, duration_s); ended_at NULL while open.

    A NULL label breaks a run and changes nothing else. That covers the feedback of unsure windows:
    they repeat the active label, which can only interrupt a run of another label.
    """
    lab = F.coalesce(F.col(label), F.lit("\u0000"))
    d = neighbours(df.withColumn("_l", lab), key, idx, {"_prev": "_l"}, size=size)
    d = islands(d, key, idx, F.col("_prev").isNull() | (F.col("_prev") != F.col("_l")), "_run", size)
    runs = d.groupBy(*key, "_run").agg(F.first(label).alias("label"), F.min(t).alias("started_at"), F.max(t).alias("_last")).filter("label IS NOT NULL")
    held = runs.filter(F.col("_last") - F.col("started_at") >= F.when(F.col("label") == normal, off).otherwise(on))
    h = block_scan(held, key, ["_run"], index_block("_run", size), [Scan("_before", F.col("label"), "last", inclusive=False)])
    turns = h.filter(F.col("label") != F.coalesce("_before", F.lit(normal)))
    e = block_scan(turns, key, ["_run"], index_block("_run", size), [Scan("ended_at", F.col("started_at"), "last", inclusive=False, reverse=True)])
    return e.filter(F.col("label") != normal).select(*key, "label", "started_at", "ended_at", (F.col("ended_at") - F.col("started_at")).alias("duration_s"))


def interval_union(df: DataFrame, key: list[str], id_: str, start: str, end: str, block: Column) -> DataFrame:
    """Total length covered by the intervals of a key; touching intervals merge."""
    d = block_scan(df, key, [start, id_], block, [Scan("_cur", F.col(end), "max", inclusive=False)])
    return d.groupBy(*key).agg(F.sum(F.greatest(F.lit(0.0), F.col(end) - F.coalesce(F.greatest(F.col(start), F.col("_cur")), F.col(start)))).alias("covered_s"))


def staleness(latest: DataFrame, sample: str, status: str, now: Column, state: str, stale_s: float = 3.0) -> DataFrame:
    """Age and display state of each stream; ``sample`` and ``status`` are last-seen seconds."""
    s, u = F.coalesce(F.col(sample), F.lit(0.0)), F.coalesce(F.col(status), F.lit(0.0))
    last = F.greatest(s, u)
    age = F.when(last > 0, now - last)
    live = F.when(F.col(sample).isNotNull() & (s > u), "file_stream").otherwise(F.coalesce(F.col(state), F.lit("waiting")))
    return latest.withColumns({"age_s": F.round(age, 3), "display_state": F.when(age.isNull() | (age > stale_s), "stale").otherwise(live)})


def segment_kind(action: Column, event_type: Column) -> Column:
    return F.when(action.isin(CARDIO), "cardio").when(event_type == "set_ended", "strength").otherwise("other")


def merge_activities(segments: DataFrame, session: str, block: Column) -> DataFrame:
    """Adjacent equal actions of a session become one item: sets for strength, seconds otherwise."""
    order = ["start", "seq"]
    d = block_scan(segments, [session], order, block, [Scan("_prev", F.col("action"), "last", inclusive=False)])
    first = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("action")), F.struct(*order))
    d = block_scan(d.withColumn("_new", first), [session], order, block, [Scan("_item", F.col("_new"), "last")])
    timed = F.when(F.col("kind") == "strength", 0).otherwise(F.bround(F.col("duration_s"), 0).cast("long"))
    return d.groupBy(session, "_item").agg(F.min_by("action", F.struct(*order)).alias("action"), F.min_by("kind", F.struct(*order)).alias("kind"), F.min("start").alias("start"),
                                           F.count_if(F.col("kind") == "strength").alias("sets"), F.sum(timed).alias("duration_seconds")).drop("_item")


def session_totals(sessions: DataFrame, segments: DataFrame, session: str) -> DataFrame:
    """Effective end, length and active time; sessions without segments are left out."""
    g = segments.groupBy(session).agg(F.max_by("end", F.struct("start", "seq")).alias("_last"), F.sum("duration_s").alias("active_s"))
    j = sessions.join(g, session)
    end = F.coalesce("end", "_last")
    return j.withColumns({"end": end, "duration_s": F.greatest(F.lit(0.0), end - F.col("start"))}).drop("_last")


def daily_totals(totals: DataFrame, tz: str = "UTC") -> DataFrame:
    """Day totals in the given time zone; ``start`` is epoch seconds."""
    day = F.date_format(F.from_utc_timestamp(F.timestamp_micros((F.col("start") * 1000000).cast("long")), tz), "yyyy-MM-dd")
    g = totals.groupBy(day.alias("date")).agg(F.sum("duration_s").alias("_d"), F.sum("active_s").alias("_a"), F.count(F.lit(1)).alias("session_count"))
    return g.select("date", F.bround("_d", 0).cast("long").alias("total_workout_seconds"), F.bround("_a", 0).cast("long").alias("active_seconds"), "session_count")


def upsert_events(store: DataFrame, arrived: DataFrame, id_: str, order: str) -> DataFrame:
    """Events of a batch that are new: first copy of each id, without the ids the store has."""
    rest = [c for c in arrived.columns if c != id_]
    one = arrived.groupBy(id_).agg(F.min_by(F.struct(*rest), order).alias("_e")).select(id_, "_e.*")
    return one.join(store.select(id_), id_, "left_anti")


def sessions_of_events(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Session rows derived from workout events instead of updated in place."""
    start = F.min(F.when(F.col("type") == "workout_started", F.col("timestamp"))).alias("start")
    end = lambda c: F.max(F.when(F.col("type") == "workout_ended", F.col(c)))
    return events.groupBy(key).agg(start, end("end_timestamp").alias("end"), end("duration_seconds").alias("active_seconds"), end("sets").alias("set_count")).filter("start IS NOT NULL")


def segments_of_events(events: DataFrame) -> DataFrame:
    d = events.filter(F.col("type").isin("set_ended", "cardio_ended", "activity_ended"))
    return d.select("session_id", "action", segment_kind(F.col("action"), F.col("type")).alias("kind"), F.col("start_timestamp").alias("start"), F.col("timestamp").alias("end"),
                    F.col("duration_seconds").alias("duration_s"), "confidence", F.col("timestamp").alias("seq"))


def device_health(df: DataFrame, key: str) -> DataFrame:
    """Counters per device; the same aggregate runs on a stream in update mode."""
    span = F.max("t") - F.min("t")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("notifications"), F.sum("frames").alias("frames"), F.sum("discarded").alias("discarded_bytes"),
                               F.when(span > 0, (F.sum("frames") - 1) / span).otherwise(0.0).alias("rate_hz"), F.max("t").alias("last_seen"))
