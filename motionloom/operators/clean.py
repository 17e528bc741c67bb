"""Repair of short sensor faults. Every step has a bounded frame, so blocks with a halo are exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .ordered import BLOCK_ROWS, Scan, block_scan, block_window, exact_percentile, index_block, keep_core, spread_join, with_halo

MAD_SCALE = 0.67448975


def half_even(x: float) -> int:
    return int(round(x))


def hampel_width(fs: float | None, seconds: float = 0.15) -> int:
    return max(5, (max(5, half_even(fs * seconds)) if fs else 7) | 1)


def gap_limit(fs: float | None) -> int:
    return max(1, half_even(fs * 0.25)) if fs else 5


def smooth_width(fs: float | None, seconds: float = 0.06) -> int:
    return max(1, half_even(fs * seconds)) if fs else 3


def isolated_zero(x: Column, w: W) -> Column:
    """A single zero between close neighbours of one sign."""
    left, right = F.lag(x).over(w), F.lead(x).over(w)
    base = (left + right) / 2
    near = F.abs(left - right) <= F.greatest(0.2 * F.abs(base), F.lit(0.01))
    return F.coalesce((x == 0) & (F.signum(left) == F.signum(right)) & near & (F.abs(base) > 0.02), F.lit(False))


def rolling_median(x: Column, w: W, width: int) -> Column:
    """Centred median, NULL below max(3, width // 3) values."""
    frame = w.rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(x).over(frame) >= max(3, width // 3), F.percentile(x, F.lit(0.5)).over(frame))


def hampel_spike(x: Column, dev: Column, mad: Column, w: W, n_sigma: float = 8.0) -> Column:
    limit = n_sigma * 1.4826 * mad
    close = F.abs(F.lag(x).over(w) - F.lead(x).over(w)) <= F.greatest(0.25 * dev, F.lit(1e-9))
    return F.coalesce((dev > limit) & (limit > 1e-12) & close, F.lit(False))


def _lerp(x: Column, idx: Column, lv: Column, li: Column, rv: Column, ri: Column) -> Column:
    between = lv + (rv - lv) * (idx - li) / (ri - li)
    return F.coalesce(x, F.when(li.isNotNull() & ri.isNotNull(), between), lv, rv)


def smooth(x: Column, w: W, width: int) -> Column:
    return F.avg(x).over(w.rowsBetween(-(width // 2), width - 1 - width // 2)) if width > 1 else x


def fill_short_gaps(df: DataFrame, key: list[str], idx: str, channels: list[str], limit: int, size: int = BLOCK_ROWS,
                    strict: bool = False) -> DataFrame:
    """Fill gaps up to ``limit`` rows from each side; ``strict`` leaves gaps longer than ``limit`` whole.

    The value on the far side of a gap sets the slope, however far it is: a carried scan finds it.
    """
    scans = []
    for c in channels:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(c).alias("v")))
        scans += [Scan(f"_l_{c}", at, "last"), Scan(f"_r_{c}", at, "last", reverse=True)]
    d = block_scan(df, key, [idx], index_block(idx, size), scans)
    i, out = F.col(idx), {}
    for c in channels:
        l, r = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        near = F.coalesce(i - l["i"] <= limit, F.lit(False)) | F.coalesce(r["i"] - i <= limit, F.lit(False))
        if strict:
            near = F.coalesce(r["i"] - l["i"] - 1 <= limit, near)
        value = _lerp(F.col(c), i, l["v"], l["i"], r["v"], r["i"])
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(near, value)
    return d.withColumns(out).drop(*[s.name for s in scans])


def impute_linear_all(df: DataFrame, key: list[str], idx: str, channels: list[str], size: int = BLOCK_ROWS) -> DataFrame:
    """Unlimited linear fill in both directions, then 0 for a channel without any value."""
    filled = fill_short_gaps(df, key, idx, channels, limit=1 << 60, size=size)
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in channels})


def smooth_centred(df: DataFrame, key: list[str], idx: str, channels: list[str], width: int, size: int = BLOCK_ROWS) -> DataFrame:
    w = block_window(key, idx)
    return keep_core(with_halo(df, idx, width, width, size).withColumns({c: smooth(F.col(c), w, width) for c in channels}))


def clean_channels(df: DataFrame, key: list[str], idx: str, channels: list[str], fs: float | None,
                   hampel_s: float = 0.15, smooth_s: float = 0.06, size: int = BLOCK_ROWS, widths: tuple[int, int, int] | None = None) -> DataFrame:
    """zero -> spike -> fill -> smooth for each channel, at one sampling rate.

    Adds ``<c>_zero``, ``<c>_spike`` and ``<c>_gap`` (missing after detection) masks and keeps the
    original as ``<c>_raw``. Detection and smoothing have bounded frames (blocks with a halo); the
    fill needs the far end of a gap of any length, so it is a carried scan.
    """
    width, limit, sw = widths or (hampel_width(fs, hampel_s), gap_limit(fs), smooth_width(fs, smooth_s))
    reach = 3 + 2 * (width // 2)
    w = block_window(key, idx)
    d = with_halo(df, idx, reach, reach, size).withColumns({f"{c}_raw": F.col(c) for c in channels})
    d = d.withColumns({f"{c}_zero": isolated_zero(F.col(c), w) for c in channels})
    d = d.withColumns({c: F.when(~F.col(f"{c}_zero"), F.col(c)) for c in channels})
    d = d.withColumns({f"{c}_dev": F.abs(F.col(c) - rolling_median(F.col(c), w, width)) for c in channels})
    d = d.withColumns({f"{c}_mad": rolling_median(F.col(f"{c}_dev"), w, width) for c in channels})
    d = d.withColumns({f"{c}_spike": hampel_spike(F.col(c), F.col(f"{c}_dev"), F.col(f"{c}_mad"), w) for c in channels})
    d = d.withColumns({c: F.when(~F.col(f"{c}_spike"), F.col(c)) for c in channels})
    d = d.withColumns({f"{c}_gap": F.col(c).isNull() for c in channels})
    d = keep_core(d.drop(*[f"{c}_{s}" for c in channels for s in ("dev", "mad")]))
    d = fill_short_gaps(d, key, idx, channels, limit, size)
    return smooth_centred(d, key, idx, channels, sw, size) if sw > 1 else d


def rate_widths(fs: str) -> Column:
    """Widths of spike frame, gap and smoothing at the rate in column ``fs`` (NULL: the defaults), as a struct."""
    whole = lambda seconds: F.bround(F.col(fs) * seconds, 0).cast("int")
    spike = F.greatest(F.lit(5), F.coalesce(F.greatest(F.lit(5), whole(0.15)), F.lit(7)).bitwiseOR(F.lit(1)))
    return F.struct(spike.alias("spike"), F.coalesce(F.greatest(F.lit(1), whole(0.25)), F.lit(5)).alias("gap"), F.coalesce(F.greatest(F.lit(1), whole(0.06)), F.lit(3)).alias("smooth"))


def clean_by_rate(df: DataFrame, key: list[str], idx: str, channels: list[str], fs: str, size: int = BLOCK_ROWS) -> DataFrame:
    """``clean_channels`` when each key has its own rate: one branch per distinct set of frame widths.

    Widths follow each key's own rate; their distinct sets are bounded by the sensors' fastest rate.
    """
    d = staged(df.withColumn("_w", rate_widths(fs)), "by_rate")
    sets = [tuple(r) for r in d.select("_w.*").distinct().orderBy("spike", "gap", "smooth").collect()]
    parts = [clean_channels(d.filter((F.col("_w.spike") == s) & (F.col("_w.gap") == g) & (F.col("_w.smooth") == m)), key, idx, channels, None, size=size, widths=(s, g, m)) for s, g, m in sets]
    return reduce(lambda a, b: a.unionByName(b), parts).drop("_w") if parts else clean_channels(df, key, idx, channels, None, size=size)


def row_flags(d: DataFrame, channels: list[str], limits: dict[str, float]) -> DataFrame:
    """``row_repaired`` and ``row_anomaly`` over all channels of a cleaned frame with jump masks."""
    any_of = lambda cols: reduce(lambda a, b: a | b, cols)
    repaired = [F.col(f"{c}_zero") | F.col(f"{c}_spike") for c in channels]
    raw = [F.col(f"{c}_raw").isNull() | F.col(f"{c}_jump") | over_limit(F.col(f"{c}_raw"), limits[c]) for c in channels]
    return d.withColumns({"row_repaired": any_of(repaired), "row_anomaly": any_of(repaired + raw)})


def over_limit(x: Column, limit: float) -> Column:
    return F.coalesce(F.abs(x) > limit, F.lit(False))


def long_channels(df: DataFrame, ids: list[str], channels: list[str]) -> DataFrame:
    return df.unpivot(ids, channels, "channel", "x")


def robust_limits(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Median and MAD per key, exact."""
    med = exact_percentile(df, key, value, {"med": 0.5})
    dev = spread_join(df.select(*key, value), med, key, "inner").withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    return med.join(exact_percentile(dev, key, "_dev", {"mad": 0.5}), key)


def robust_flag(df: DataFrame, key: list[str], value: str, threshold: float, out: str, limits: DataFrame | None = None) -> DataFrame:
    """Rows whose robust z-score passes the threshold; a flat channel (MAD 0) has none."""
    z = MAD_SCALE * F.abs(F.col(value) - F.col("med")) / F.col("mad")
    d = spread_join(df, limits if limits is not None else robust_limits(df, key, value), key)
    return d.withColumn(out, F.coalesce(F.when(F.col("mad") > 1e-12, z > threshold), F.lit(False))).drop("med", "mad")


def robust_outlier(df: DataFrame, key: list[str], value: str, out: str = "outlier") -> DataFrame:
    return robust_flag(df, key, value, 8.0, out)


def steps(df: DataFrame, key: list[str], idx: str, value: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_step``, the absolute change from the previous row."""
    d = with_halo(df, idx, 1, 0, size).withColumn("_step", F.abs(F.col(value) - F.lag(value).over(block_window(key, idx))))
    return keep_core(d)


def robust_jump(df: DataFrame, key: list[str], idx: str, value: str, out: str = "jump", size: int = BLOCK_ROWS,
                basis: DataFrame | None = None) -> DataFrame:
    """Robust z-score of the step. ``basis`` is a cheaper frame with the same key, idx and value for the limits."""
    limits = robust_limits(steps((df if basis is None else basis).select(*key, idx, value), key, idx, value, size), key, "_step")
    return robust_flag(steps(df, key, idx, value, size), key, "_step", 10.0, out, limits).drop("_step")


def robust_jumps(df: DataFrame, key: list[str], idx: str, outs: dict[str, str], size: int = BLOCK_ROWS, basis: DataFrame | None = None) -> DataFrame:
    """``robust_jump`` of several channels in one pass: ``outs`` maps each channel to its flag. ``basis`` as there."""
    names = {v: f"_step_{v}" for v in outs}

    def stepped(d: DataFrame) -> DataFrame:
        change = {n: F.abs(F.col(v) - F.lag(v).over(block_window(key, idx))) for v, n in names.items()}
        return keep_core(with_halo(d, idx, 1, 0, size).withColumns(change))

    source = stepped((df if basis is None else basis).select(*key, idx, *outs))
    limits = robust_limits(long_channels(source, key, list(names.values())), [*key, "channel"], "x")
    of = lambda c, n: F.max(F.when(F.col("channel") == n, F.col(c))).alias(f"{c}{n}")
    limits = limits.groupBy(*key).agg(*[of(c, n) for n in names.values() for c in ("med", "mad")])
    d = spread_join(stepped(df), limits, key)
    z = {v: MAD_SCALE * F.abs(F.col(n) - F.col(f"med{n}")) / F.col(f"mad{n}") for v, n in names.items()}
    flags = {outs[v]: F.coalesce(F.when(F.col(f"mad{n}") > 1e-12, z[v] > 10.0), F.lit(False)) for v, n in names.items()}
    return d.withColumns(flags).drop(*names.values(), *[f"{c}{n}" for n in names.values() for c in ("med", "mad")])


def dedupe_keep_first(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """One row per distinct ``columns``: the one with the smallest ``row``. Aggregates map-side first."""
    rest = [c for c in df.columns if c not in columns and c != row]
    first = F.min_by(F.struct(row, *rest), F.col(row)).alias("_f")
    return df.groupBy(*columns).agg(first).select(*columns, "_f.*")


def longest_runs(df: DataFrame, key: list[str], idx: str, flags: dict[str, Column], size: int = BLOCK_ROWS) -> DataFrame:
    """Longest run of consecutive true rows per key, for several flags at once."""
    d = df.withColumns({f"_f_{n}": F.coalesce(f, F.lit(False)) for n, f in flags.items()})
    scans = [Scan(f"_s_{n}", F.when(~F.col(f"_f_{n}"), F.col(idx)), "last") for n in flags]
    d = block_scan(d, key, [idx], index_block(idx, size), scans)
    length = {n: F.when(F.col(f"_f_{n}"), F.col(idx) - F.coalesce(F.col(f"_s_{n}"), F.lit(-1))).otherwise(0) for n in flags}
    return d.groupBy(*key).agg(*[F.max(v).alias(n) for n, v in length.items()])
