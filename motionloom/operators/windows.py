"""Sliding windows and their features.

Rows are shuffled once, to (key, block) with a look-ahead halo: an overlap of four costs no extra network.
Feature sets are computed by the kernels of ``functions.kernels`` on strided windows of each sorted block, many
windows of many blocks at a time; no row is copied per window. Plain aggregates explode the rows to their
windows instead; grouping by (key, block, window) is a refinement of the same partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalar as S
from ..functions.spectral import autocorr_period, partial_dft, spectral
from ..session import staged
from .ordered import BLOCK_ROWS, block_window, exact_percentile, spread_join, whole_groups, with_halo

AXES = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]


def window_rows(seconds: float, fs: float, minimum: int = 16) -> int:
    return max(minimum, int(round(seconds * fs)))


def step_by_overlap(n: int, overlap: float) -> int:
    return max(1, int(round(n * (1 - overlap))))


def step_by_hop(seconds: float, fs: float) -> int:
    return max(1, int(round(seconds * fs)))


def blocked(df: DataFrame, idx: str, n: int, size: int = BLOCK_ROWS) -> DataFrame:
    return with_halo(df, idx, 0, n - 1, size)


def explode_windows(d: DataFrame, idx: str, n: int, step: int, size: int = BLOCK_ROWS) -> DataFrame:
    """One row per (row, window) for the windows that start in the row's block; needs ``blocked`` rows."""
    i = F.col(idx)
    lo, hi = F.greatest(F.lit(0), F.ceil((i - (n - 1)) / step)), F.floor(i / step)
    d = d.withColumns({"_w0": lo, "_w1": hi}).filter("_w0 <= _w1").withColumn("win", F.explode(F.sequence("_w0", "_w1")))
    return d.filter(F.floor(F.col("win") * step / F.lit(size)) == F.col("_blk")).drop("_w0", "_w1", "_core")


def sliding_windows(df: DataFrame, key: list[str], idx: str, n: int, step: int, aggs: list[Column], size: int = BLOCK_ROWS) -> DataFrame:
    """Full windows of n rows every ``step`` rows with the given aggregates. Needs step <= n."""
    d = blocked(df, idx, n, size).repartition(*key, "_blk")
    e = explode_windows(d, idx, n, step, size)
    g = e.groupBy(*key, "_blk", "win").agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return g.filter(F.col("_n") == n).drop("_n", "_blk")


def _stats(c: str, fs: Column | float, ddof: int, names: tuple[str, ...]) -> list[Column]:
    x = F.col(c)
    quart = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    rate = fs if isinstance(fs, Column) else F.lit(fs)
    step = F.sqrt(F.avg((x - F.col(f"_p_{c}")) * (x - F.col(f"_p_{c}"))))
    all_ = {"mean": F.avg(x), "std": (F.stddev_samp if ddof else F.stddev_pop)(x), "rms": F.sqrt(F.avg(x * x)), "range": F.max(x) - F.min(x),
            "iqr": quart[1] - quart[0], "jerk_rms": F.coalesce(step, F.lit(0.0)) * rate}
    return [all_[n].alias(f"{c}_{n}") for n in names if n in all_]


def _magnitude(cols: list[str]) -> Column:
    return S.norm(*[F.col(c) for c in cols])


def _series(channels: list[str], idx: str) -> Column:
    """All channels of a window in row order: array of structs; NULLs stay."""
    return F.sort_array(F.collect_list(F.struct(F.col(idx), *[F.col(c) for c in channels]))).alias("_series")


def _member(c: str) -> Column:
    return F.transform("_series", lambda s: s[c])


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + f(v))


def sorted_percentile(array: Column, p: float) -> Column:
    """Linear-interpolated percentile of a sorted array."""
    at = (F.size(array) - 1) * F.lit(p)
    lo, hi = F.get(array, F.floor(at).cast("int")), F.get(array, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def _sma() -> Column:
    """Mean over the window of the summed distances of the three axes from their means."""
    far = lambda s: sum((F.abs(s[c] - F.col(f"{c}_mean")) for c in AXES[1:3]), F.abs(s["acc_x"] - F.col("acc_x_mean")))
    whole = F.filter(F.transform("_series", far), lambda v: v.isNotNull())
    return _sum(whole, lambda v: v) / F.size(whole)


def _spectra(g: DataFrame, arrays: dict[str, Column], fs: Column | float, names: tuple[str, str], period: bool, **kw) -> DataFrame:
    out = {f"_s_{c}": spectral(a, fs, **kw) for c, a in arrays.items()}
    g = g.withColumns(out)
    g = g.withColumns({**{f"{c}_{names[0]}": F.nanvl(F.col(f"_s_{c}.dominant_hz"), F.lit(None)) for c in arrays},
                       **{f"{c}_{names[1]}": F.nanvl(F.col(f"_s_{c}.entropy"), F.lit(None)) for c in arrays}})
    if period:
        g = g.withColumns({f"{c}_period_s": autocorr_period(a, float(fs)) for c, a in arrays.items()})
    return g.drop("_series", *out)


def _values(channels: list[str]) -> dict[str, Column]:
    return {c: F.filter(_member(c), lambda v: v.isNotNull()) for c in channels}


#: Windows that a kernel works on at a time.
STACK = 512


def kernel_windows(df: DataFrame, key: list[str], idx: str, cols: list[str], n: int, step: int, names: list[str], features: Callable[[np.ndarray], dict[str, np.ndarray]], size: int = BLOCK_ROWS,
                   complete: int = 0) -> DataFrame:
    """(key, win, names): ``features`` of the full windows of ``n`` rows every ``step`` rows of the columns ``cols``.

    ``features`` gets stacks (windows, rows, columns) with NaN for NULL. Windows with a missing sample among the
    first ``complete`` columns are left out. A block with its halo is what a task holds at a time.
    """
    rows = df.select(*key, F.col(idx).cast("long").alias("_i"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    rows = blocked(rows, "_i", n, size).drop("_core").repartition(*key, "_blk").sortWithinPartitions(*key, "_blk", "_i")
    kinds = [rows.schema[k].dataType.simpleString() for k in key]
    by = [*key, "_blk"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, ready = [], None, []

        def windows():
            index, values = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            wins = np.arange(-(-group[-1] * size // step), -(-(group[-1] + 1) * size // step))
            at = np.searchsorted(index, wins * step)
            full = at + n <= len(index)
            wins, at = wins[full], at[full]
            full = (index[at] == wins * step) & (index[at + n - 1] == wins * step + n - 1)
            view = np.lib.stride_tricks.sliding_window_view(values, n, axis=0) if full.any() else None
            for a in range(0, int(full.sum()), STACK):
                ready.append((group, wins[full][a:a + STACK], view[at[full][a:a + STACK]].transpose(0, 2, 1)))

        def answers():
            x = np.concatenate([r[2] for r in ready])
            keys = [[v for r in ready for v in [r[0][k]] * len(r[1])] for k in range(len(key))]
            wins = np.concatenate([r[1] for r in ready])
            ready.clear()
            good = np.isfinite(x[..., :complete]).all((1, 2))
            with np.errstate(invalid="ignore"):
                found = features(x[good])
            columns = [pa.array([v for v, g in zip(vs, good) if g], types[i]) for i, vs in enumerate(keys)] + [pa.array(wins[good])]
            return pa.record_batch([*columns, *[pa.array(found[c], pa.float64(), from_pandas=True) for c in names]], names=[*key, "win", *names])

        types = None
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(k).type for k in key]
            index = b.column("_i").to_numpy()
            values = np.stack([b.column(f"_c{i}").to_numpy(zero_copy_only=False) for i in range(len(cols))], 1)
            turns = np.zeros(len(index), bool)
            for c in by:
                codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                turns[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(turns), len(index)]
            for a, z in zip(starts, starts[1:]):
                now = tuple(b.column(c)[int(a)].as_py() for c in by)
                if group is not None and now != group:
                    windows()
                    held = []
                    if sum(len(r[1]) for r in ready) >= STACK:
                        yield answers()
                group = now
                held.append((index[a:z], values[a:z]))
        if held:
            windows()
        if ready:
            yield answers()

    return rows.mapInArrow(cut, ", ".join([*(f"`{k}` {t}" for k, t in zip(key, kinds)), "win bigint", *(f"`{c}` double" for c in names)]))


def window_stats_v2(df: DataFrame, key: list[str], idx: str, axes: dict[str, str], fs: float = 50.0, window_s: float = 4.0, hop_s: float = 1.0,
                    size: int = BLOCK_ROWS, names: list[str] | None = None) -> DataFrame:
    """The 91 features of the second generation: population std, dynamic part about the window's median.

    ``axes`` maps acc_x..gyro_z to the input's columns; ``names`` picks some of the features.
    """
    n, step = window_rows(window_s, fs), step_by_hop(hop_s, fs)
    names = K.V2_NAMES if names is None else names
    return kernel_windows(df, key, idx, [axes[a] for a in AXES], n, step, names, lambda x: K.v2(x, fs, names), size)


def _aggregate_v2(e: DataFrame, by: list[str], idx: str, fs: float, n: int) -> DataFrame:
    """Features of exploded window rows in one aggregation.

    What depends on a window's own mean or median (sma, the dynamic part) is taken from the
    window's array afterwards, so the exploded rows are grouped once and not windowed first.
    """
    channels = AXES + ["acc_mag", "gyro_mag"]
    aggs = [a for c in channels for a in _stats(c, fs, 0, ("mean", "std", "rms", "range", "iqr", "jerk_rms"))]
    for f in ("acc", "gyro"):
        for a, b in ("xy", "xz", "yz"):
            x, y = f"{f}_{a}", f"{f}_{b}"
            scale = F.stddev_pop(x) * F.stddev_pop(y)
            aggs.append(F.when(scale * n > 1e-12, F.covar_pop(x, y) / scale).otherwise(0.0).alias(f"{f}_corr_{a}{b}"))
    g = e.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *aggs, F.percentile("acc_mag", F.lit(0.5)).alias("_med"), _series(channels, idx)).filter(F.col("_n") == n).drop("_n")
    d = F.col("_dyn")
    g = g.withColumn("_dyn", F.transform(_member("acc_mag"), lambda v: F.abs(v - F.col("_med")))).withColumns({"_ord": F.array_sort("_dyn"), "dynamic_acc_mean": _sum(d, lambda v: v) / n})
    steps = F.zip_with(F.slice(d, 2, n - 1), F.slice(d, 1, n - 1), lambda b, a: (b - a) * (b - a))
    length = F.greatest(S.norm(*[F.col(f"{c}_mean") for c in AXES[:3]]), F.lit(1e-9))
    g = g.withColumns({
        "dynamic_acc_std": F.sqrt(_sum(d, lambda v: (v - F.col("dynamic_acc_mean")) * (v - F.col("dynamic_acc_mean"))) / n),
        "dynamic_acc_rms": F.sqrt(_sum(d, lambda v: v * v) / n), "dynamic_acc_range": F.get("_ord", F.lit(n - 1)) - F.get("_ord", F.lit(0)),
        "dynamic_acc_iqr": sorted_percentile(F.col("_ord"), 0.75) - sorted_percentile(F.col("_ord"), 0.25),
        "dynamic_acc_jerk_rms": F.sqrt(_sum(steps, lambda v: v) / (n - 1)) * fs, "acc_sma": _sma(),
        **{f"gravity_{c[-1]}": F.col(f"{c}_mean") / length for c in AXES[:3]}})
    arrays = {**{c: _member(c) for c in channels}, "dynamic_acc": d}
    return _spectra(g, arrays, fs, ("dominant_hz", "spectral_entropy"), True).drop("_dyn", "_ord", "_med")


def window_stats_v1(df: DataFrame, key: list[str], idx: str, axes: dict[str, str], fs: float = 50.0, window_s: float = 2.0, overlap: float = 0.5,
                    size: int = BLOCK_ROWS) -> DataFrame:
    """First generation: sample std, MAD, dynamic part about 1 g, missing samples skipped.

    ``axes`` maps acc_x.. gyro_z and optionally angle_x.. angle_z to columns.
    """
    n = window_rows(window_s, fs)
    step = step_by_overlap(n, overlap)
    names = [f"{c}_{s}" for c in [*axes, "acc_mag", "gyro_mag", "dynamic_acc"] for s in K.V1_STATS] + ["acc_sma"]
    g = kernel_windows(df, key, idx, list(axes.values()), n, step, names, lambda x: K.v1(x, list(axes), fs), size)
    return g.withColumns({"window_start_s": F.col("win") * step / F.lit(fs), "window_end_s": (F.col("win") * step + n - 1) / F.lit(fs)})


def live_features_v1(df: DataFrame, key: list[str], idx: str, t: str, axes: dict[str, str], n: int, step: int, size: int = BLOCK_ROWS) -> DataFrame:
    """The live subset (mean, std, rms, dominant, entropy, sma) at the rate observed in each window, with that rate."""
    names = [f"{c}_{s}" for c in [*AXES, "acc_mag", "gyro_mag", "dynamic_acc"] for s in ("mean", "std", "rms", "dom_freq_hz", "spec_entropy")] + ["acc_sma"]

    def live(x: np.ndarray) -> dict[str, np.ndarray]:
        fs = (n - 1) / np.maximum(x[:, -1, 6] - x[:, 0, 6], 1e-6)
        return {"fs": fs, **K.v1(x[..., :6], AXES, fs, names)}

    return kernel_windows(df, key, idx, [*[axes[a] for a in AXES], t], n, step, ["fs", *names], live, size)


def contrast_windows(df: DataFrame, key: list[str], idx: str, axes: dict[str, str], fs: float = 50.0, window_s: float = 2.0, overlap: float = 0.5,
                     size: int = BLOCK_ROWS) -> DataFrame:
    """Action-contrast features of windows; ``axes`` maps acc_*, gyro_* and angle_* to columns."""
    n = window_rows(window_s, fs)
    cols = [axes[a] for a in [*AXES, "angle_x", "angle_y", "angle_z"]]
    names = list(K.contrast(np.zeros((0, n, 9)), fs))
    return kernel_windows(df, key, idx, cols, n, step_by_overlap(n, overlap), names, lambda x: K.contrast(x, fs), size)


def recording_contrast(df: DataFrame, key: list[str], idx: str, axes: dict[str, str], fs: float = 50.0, size: int = BLOCK_ROWS, bins: int = 1 << 14) -> DataFrame:
    """The contrast features of whole recordings of any length.

    Recordings of up to ``size`` rows are worked on whole, many at a time, after one shuffle. For longer ones percentiles use
    rank selection and the spectrum sums the blocks' shares of each DFT bin, so no long recording is ever held by one task.
    """
    rows = df.select(*key, idx, *[F.col(v).cast("double").alias(k) for k, v in axes.items()])
    long = staged(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select(*key), "long")
    if long.isEmpty():
        return _short_contrast(rows, key, idx, fs)
    short = _short_contrast(rows.join(long, key, "left_anti"), key, idx, fs)
    return short.unionByName(_long_contrast(rows.join(long, key, "left_semi"), key, idx, fs, size, bins))


CONTRAST = ["n", "acc_mag_std", "gyro_mag_mean", "gyro_mag_std", *[f"{c}_std" for c in AXES], "gyro_mag_p95", *[f"angle_{a}_range_p90" for a in "xyz"], "acc_dynamic_p95",
            "acc_dominant_hz", "gyro_dominant_hz"]


def _short_contrast(rows: DataFrame, key: list[str], idx: str, fs: float) -> DataFrame:
    """Contrast features of recordings that one task can hold, from their rows in order."""
    channels = [*AXES, "angle_x", "angle_y", "angle_z"]
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x = np.stack([table.column(c).to_numpy() for c in channels], 1)
        at, found, kept = table.column(idx).to_numpy(), [], []
        for a, z in zip(starts, [*starts[1:], len(x)]):
            v = K.recording(x[a:z], int(at[a]), fs)
            if v is not None:
                kept.append(a)
                found.append(v)
        out = table.select(key).take(pa.array(kept, pa.int64()))
        for c in CONTRAST:
            out = out.append_column(c, pa.array([v[c] for v in found], pa.int64() if c == "n" else pa.float64(), from_pandas=True))
        return out

    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    rows = rows.filter(known).select(*key, idx, *channels).repartition(*key).sortWithinPartitions(*key, idx)
    return rows.mapInArrow(whole_groups(key, work), ", ".join([types, "n bigint", *(f"`{c}` double" for c in CONTRAST[1:])]))


def _long_contrast(rows: DataFrame, key: list[str], idx: str, fs: float, size: int, bins: int) -> DataFrame:
    src = rows.withColumns({"acc_mag": _magnitude(AXES[:3]), "gyro_mag": _magnitude(AXES[3:])})
    stats = src.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("acc_mag").alias("acc_mag_std"), F.avg("gyro_mag").alias("gyro_mag_mean"),
                                  F.stddev_pop("gyro_mag").alias("gyro_mag_std"), *[F.stddev_pop(c).alias(f"{c}_std") for c in AXES],
                                  F.avg("acc_mag").alias("_ma"), F.avg("gyro_mag").alias("_mg"))
    med = exact_percentile(src, key, "acc_mag", {"_med": 0.5})
    dyn = spread_join(src.select(*key, "acc_mag"), med, key).withColumn("_dyn", F.abs(F.col("acc_mag") - F.col("_med")))
    long = src.unpivot(key, ["gyro_mag", "angle_x", "angle_y", "angle_z"], "_ch", "_x")
    pct = exact_percentile(long, [*key, "_ch"], "_x", {"lo": 0.05, "hi": 0.95}).groupBy(*key).agg(
        F.max(F.when(F.col("_ch") == "gyro_mag", F.col("hi"))).alias("gyro_mag_p95"),
        *[F.max(F.when(F.col("_ch") == f"angle_{a}", F.col("hi") - F.col("lo"))).alias(f"angle_{a}_range_p90") for a in "xyz"])
    d95 = exact_percentile(dyn, key, "_dyn", {"acc_dynamic_p95": 0.95})
    peak = _dominant_bins(src, stats, key, idx, fs, size, bins)
    return stats.drop("_ma", "_mg").join(pct, key).join(d95, key).join(peak, key).select(*key, *CONTRAST)


def _dominant_bins(src: DataFrame, stats: DataFrame, key: list[str], idx: str, fs: float, size: int, bins: int) -> DataFrame:
    n = F.col("n")
    lo, hi = F.ceil(0.15 * n / fs - 1e-9), F.floor(F.lit(min(3.0, fs / 2)) * n / fs + 1e-9)
    chunks = stats.select(*key, "n", "_ma", "_mg", F.explode(F.sequence(F.floor(lo / bins), F.floor(hi / bins))).alias("_kc"), lo.alias("_lo"), hi.alias("_hi"))
    rows = src.select(*key, idx, "acc_mag", "gyro_mag").withColumn("_blk", F.floor(F.col(idx) / size))
    j = spread_join(rows, chunks, key, "inner")

    def share(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        total, kc = int(pdf["n"].iloc[0]), int(pdf["_kc"].iloc[0])
        k0, k1 = max(int(pdf["_lo"].iloc[0]), kc * bins), min(int(pdf["_hi"].iloc[0]), (kc + 1) * bins - 1)
        out = {"_bin": np.arange(k0, k1 + 1)}
        for name, mean in (("acc", "_ma"), ("gyro", "_mg")):
            y = partial_dft((pdf[f"{name}_mag"] - pdf[mean]).to_numpy(), int(pdf[idx].iloc[0]), total, k0, k1 - k0 + 1)
            out[f"{name}_re"], out[f"{name}_im"] = y.real, y.imag
        frame = pd.DataFrame(out)
        for name, value in zip(key, group):
            frame.insert(0, name, value)
        return frame

    types = ", ".join(f"{k} {src.schema[k].dataType.simpleString()}" for k in key)
    parts = j.groupBy(*key, "_blk", "_kc").applyInPandas(share, f"{types}, _bin bigint, acc_re double, acc_im double, gyro_re double, gyro_im double")
    total = parts.groupBy(*key, "_bin").agg(*[F.sum(c).alias(c) for c in ("acc_re", "acc_im", "gyro_re", "gyro_im")])
    best = lambda c: F.max_by("_bin", F.struct(F.col(f"{c}_re") * F.col(f"{c}_re") + F.col(f"{c}_im") * F.col(f"{c}_im"), -F.col("_bin")))
    return total.groupBy(*key).agg(best("acc").alias("_a"), best("gyro").alias("_g")).join(stats.select(*key, "n"), key).select(
        *key, (F.col("_a") * fs / F.col("n")).alias("acc_dominant_hz"), (F.col("_g") * fs / F.col("n")).alias("gyro_dominant_hz"))


def keep_linspace(rank: Column, n: Column, cap: int) -> Column:
    """Is ``rank`` among round(linspace(0, n - 1, cap))? All ranks when n <= cap. Pure arithmetic, no join."""
    stride = (n - 1) / F.lit(float(cap - 1))
    near = F.floor(rank / stride)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        k = near + d
        hit = hit | ((k >= 0) & (k < cap) & (F.rint(k * stride) == rank))
    return (n <= cap) | hit
