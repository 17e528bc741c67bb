"""Interpolation onto grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import BLOCK_ROWS, Scan, block_scan, block_window, keep_core, spread_join, with_halo

CHUNK = 1 << 14


def explode_range(df: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """One row per integer in [lo, hi]; long ranges are exploded in chunks, so no array grows large."""
    d = df.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).filter("_lo <= _hi")
    d = d.withColumn("_ch", F.explode(F.sequence(F.floor(F.col("_lo") / CHUNK), F.floor(F.col("_hi") / CHUNK))))
    first, last = F.greatest(F.col("_lo"), F.col("_ch") * CHUNK), F.least(F.col("_hi"), F.col("_ch") * CHUNK + CHUNK - 1)
    return d.withColumn(out, F.explode(F.sequence(first, last))).drop("_lo", "_hi", "_ch")


def lerp(a: Column, b: Column, ta: Column, tb: Column, t: Column) -> Column:
    return F.when(tb.isNull() | (tb == ta), a).otherwise(a + (b - a) * (t - ta) / (tb - ta))


def uniform_resample(df: DataFrame, key: list[str], idx: str, t: str, channels: list[str], hz: float, duration: str | None = None,
                     size: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation at k / hz up to the key's ``duration`` (a column; times start at 0), or to its last time.

    Every sample emits the grid points between itself and the next sample, so one shuffle for the
    look-ahead is all it takes. Ends are clamped. ``idx`` orders strictly increasing times.
    """
    w = block_window(key, idx)
    nxt = {f"_n_{c}": F.lead(c).over(w) for c in [t, *channels]}
    d = keep_core(with_halo(df, idx, 0, 1, size).withColumns(nxt))
    end = F.col(duration or t)  # only a key's last sample reaches its end
    hi = F.least(F.round(end * hz), F.floor((end + 1e-9) * hz))
    lo_k = F.when(F.col(idx) == 0, F.lit(0)).otherwise(F.ceil(F.col(t) * hz))
    before = F.ceil(F.col(f"_n_{t}") * hz) - 1
    hi_k = F.when(F.col(f"_n_{t}").isNull(), hi).otherwise(F.least(hi, before) if duration else before)
    g = explode_range(d, lo_k, hi_k, "k")
    at = F.col("k") / F.lit(hz)
    return g.select(*key, "k", at.alias("grid_t"), *[lerp(F.col(c), F.col(f"_n_{c}"), F.col(t), F.col(f"_n_{t}"), at).alias(c) for c in channels])


def average_duplicates(df: DataFrame, key: list[str], t: str, channels: list[str]) -> DataFrame:
    """One row per timestamp: the mean of its samples."""
    return df.groupBy(*key, t).agg(*[F.avg(c).alias(c) for c in channels])


def resample_ns(df: DataFrame, key: list[str], idx: str, ts: str, channels: list[str], rate: Column, size: int = BLOCK_ROWS) -> DataFrame:
    """Integer nanosecond grid from each key's first to last timestamp at its configured rate."""
    start = df.groupBy(*key).agg(F.min(ts).alias("_t0"))
    w = block_window(key, idx)
    d = with_halo(df.withColumn("_step", F.bround(F.lit(1e9) / rate, 0).cast("long")), idx, 0, 1, size)
    d = keep_core(d.withColumns({f"_n_{c}": F.lead(c).over(w) for c in [ts, *channels]}))
    d = spread_join(d, start, key)
    rel, nxt = F.col(ts) - F.col("_t0"), F.col(f"_n_{ts}") - F.col("_t0")
    ceil_div = lambda a: F.floor((a + F.col("_step") - 1) / F.col("_step"))
    last = F.when(F.col(f"_n_{ts}").isNull(), F.floor(rel / F.col("_step"))).otherwise(ceil_div(nxt) - 1)
    g = explode_range(d, ceil_div(rel), last, "k")
    at = F.col("_t0") + F.col("k") * F.col("_step")
    out = [lerp(F.col(c), F.col(f"_n_{c}"), F.col(ts), F.col(f"_n_{ts}"), at).alias(c) for c in channels]
    return g.select(*key, F.col("k").alias("sequence_id"), at.alias(ts), *out)


def grid_interpolate(samples: DataFrame, targets: DataFrame, key: list[str], t: str, value: str, block: Column, target_id: str) -> DataFrame:
    """As-of both sides: linear interpolation of ``value`` at arbitrary target times, clamped at the ends."""
    s = samples.select(*key, F.col(t), F.lit(0).alias("_kind"), F.lit(None).cast(targets.schema[target_id].dataType).alias(target_id),
                       F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_p"))
    q = targets.select(*key, F.col(t), F.lit(1).alias("_kind"), target_id, F.lit(None).cast(s.schema["_p"].dataType).alias("_p"))
    d = block_scan(s.unionByName(q), key, [t, "_kind", target_id], block,
                   [Scan("_l", F.col("_p"), "last"), Scan("_r", F.col("_p"), "last", reverse=True)]).filter("_kind = 1")
    l, r, at = F.col("_l"), F.col("_r"), F.col(t)
    v = F.when(l["t"] == at, l["v"]).otherwise(
        F.coalesce(l["v"] + (r["v"] - l["v"]) * (at - l["t"]) / (r["t"] - l["t"]), l["v"], r["v"]))
    return d.select(*key, target_id, v.alias(value))
