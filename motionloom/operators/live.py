"""Batch twins of the live path. They are native scans wherever the recursion has a closed form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalar as S
from ..session import staged
from . import workout as WK
from .episodes import debounce_hold
from .joins import interval_join
from .ordered import BLOCK_ROWS, STACK_ROWS, Scan, block_entries, block_scan, group_starts, index_block, islands, neighbours, number_rows, spread_join, whole_groups, with_halo
from .posture import neutral_baseline
from .resample import uniform_resample
from .windows import AXES, STACK, kernel_windows

AXIS_NAMES = ["ax", "ay", "az", "gx", "gy", "gz"]


def assign_batch_clock(df: DataFrame, key: list[str], idx: str, count: str, arrival: str, rate_hz: float = 100.0, size: int = BLOCK_ROWS) -> DataFrame:
    """Time of the first frame and the period of each notification.

    last_i = max(wish_i + span_i, last_(i-1) + 1 us + span_i), a max-plus recursion: with the running
    sum S of (span + 1 us) it is S_i plus the running maximum of (wish_i + span_i - S_i).
    """
    n, a, b = F.col(count), F.col(arrival), index_block(idx, size)
    d = neighbours(df, key, idx, {"_pa": arrival}, size=size)
    seen = a - F.col("_pa")
    d = d.withColumn("_obs", F.when((seen > 1e-5) & (seen / n >= 1 / 5000) & (seen / n <= 0.1), seen / n))
    d = block_scan(d, key, [idx], b, [Scan("period_s", F.col("_obs"), "last")]).withColumn("period_s", F.coalesce("period_s", F.lit(1.0 / rate_hz)))
    span = F.col("period_s") * (n - 1)
    wish = F.when((F.col(idx) == 0) | (n == 1), a).otherwise(a - span)
    d = d.withColumns({"_span": span, "_wish": wish})
    d = block_scan(d, key, [idx], b, [Scan("_S", F.col("_span") + 1e-6, "sum")])
    d = d.withColumn("_x", F.col("_wish") + F.col("_span") - F.col("_S"))
    d = block_scan(d, key, [idx], b, [Scan("_M", F.col("_x"), "max")])
    return d.withColumn("first_s", F.col("_M") + F.col("_S") - F.col("_span")).drop("_pa", "_obs", "_span", "_wish", "_S", "_x", "_M")


def frame_times(clocked: DataFrame, count: str) -> DataFrame:
    return clocked.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))).withColumn("t", F.col("first_s") + F.col("frame") * F.col("period_s"))


def increasing_times(df: DataFrame, key: list[str], idx: str, t: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Nudge non-increasing times by 1 us after the previous one: a running maximum of t - i us."""
    d = block_scan(df.withColumn("_u", F.col(t) - F.col(idx) * 1e-6), key, [idx], index_block(idx, size), [Scan("_m", F.col("_u"), "max")])
    return d.withColumn(t, F.col("_m") + F.col(idx) * 1e-6).drop("_u", "_m")


def split_at_stalls(df: DataFrame, key: list[str], idx: str, t: str, stall: float = 0.25, size: int = BLOCK_ROWS) -> DataFrame:
    """Add ``seg`` (index of the first row after the last stall)."""
    d = neighbours(df, key, idx, {"_pt": t}, size=size)
    return islands(d, key, idx, F.col("_pt").isNull() | (F.col(t) - F.col("_pt") > stall), "seg", size).drop("_pt")


def live_normalize(df: DataFrame, key: list[str], idx: str, t: str, channels: list[str], hz: float = 100.0, smooth: float = 0.06, size: int = BLOCK_ROWS, whole: bool = False) -> DataFrame:
    """Causal resampling to ``hz`` between stalls, then the trailing mean of ``smooth`` seconds.

    With ``whole``, captures of up to ``size`` rows are worked on whole, many at a time, in Arrow batches after one shuffle; longer
    ones, and those with a time that is not a number, in blocks. Rows without a key have no capture.
    """
    if not whole:
        return _long_normalize(df, key, idx, t, channels, hz, smooth, size)
    rows = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).select(*key, idx, F.col(t).cast("double").alias(t), *channels)
    count, odd = F.count(F.lit(1)).alias("_n"), F.bool_or(F.coalesce(F.isnan(t), F.lit(False))).alias("_odd")
    long = staged(rows.groupBy(*key).agg(count, odd).filter((F.col("_n") > size) | F.col("_odd")).select(*key), "long")
    if long.isEmpty():
        return _short_normalize(rows, key, idx, t, channels, hz, smooth)
    short = _short_normalize(rows.join(long, key, "left_anti"), key, idx, t, channels, hz, smooth)
    return short.unionByName(_long_normalize(rows.join(long, key, "left_semi"), key, idx, t, channels, hz, smooth, size))


def _short_normalize(rows: DataFrame, key: list[str], idx: str, t: str, channels: list[str], hz: float, smooth: float) -> DataFrame:
    """``_long_normalize`` for captures that one task can hold."""
    back = int(round(smooth * hz))

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        at, time = rows.column(idx).to_numpy(), rows.column(t).to_numpy()
        lowest = np.where(np.isnan(time), -np.inf, time - at * 1e-6)  # a missing time takes the one before, on by a microsecond a row
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            np.maximum.accumulate(lowest[a:z], out=lowest[a:z])
        first = np.zeros(len(at), bool)
        first[starts] = True
        kept = np.flatnonzero(lowest > -np.inf)
        owner = (np.cumsum(first) - 1)[kept]
        at, time = at[kept], lowest[kept] + at[kept] * 1e-6
        n = len(at)
        new = np.ones(n, bool)
        new[1:] = (owner[1:] != owner[:-1]) | (time[1:] - time[:-1] > 0.25)
        place = np.arange(n)
        head = np.maximum.accumulate(np.where(new, place, 0))
        last = np.append(new[1:], True)[:n]
        tail = np.minimum.accumulate(np.where(last, place, n)[::-1])[::-1]
        run = time - time[head]
        whole = time[tail] - time[head] if n else time
        top = np.minimum(np.floor(whole * hz + 0.5), np.floor((whole + 1e-9) * hz)).astype(np.int64)
        nxt = np.append(run[1:], 0.0)[:n]
        low = np.where(new, 0, np.ceil(run * hz)).astype(np.int64)
        high = np.where(last, top, np.minimum(top, np.ceil(nxt * hz).astype(np.int64) - 1))
        points = np.maximum(high - low + 1, 0)
        row = np.repeat(place, points)
        k = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(points) - points, points)
        grid, flat = k / hz, last[row] | (nxt[row] == run[row])
        after = np.minimum(row + 1, max(n - 1, 0))
        out = rows.select(key).take(pa.array(kept[row]))
        out = out.append_column("seg", pa.array(at[head[row]])).append_column("k", pa.array(k)).append_column("t", pa.array(time[head[row]] + grid))
        for c in channels:
            column = rows.column(c).combine_chunks()
            x, null = column.cast(pa.float64()).to_numpy(zero_copy_only=False)[kept], column.is_null().to_numpy(zero_copy_only=False)[kept]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                v = np.where(flat, x[row], x[row] + (x[after] - x[row]) * (grid - run[row]) / (nxt[row] - run[row]))
                gone = null[row] | (~flat & null[after])
                total, count = np.zeros(len(v)), np.zeros(len(v), np.int64)
                for j in range(back, -1, -1):  # oldest first
                    src = np.arange(len(v)) - j
                    ok = (k >= j) & ~gone[src]
                    total += np.where(ok, v[src], 0.0)
                    count += ok
                out = out.append_column(c, pa.array(total / np.maximum(count, 1), pa.float64(), mask=count == 0))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    types = ", ".join([*(f"`{x}` {kinds[x]}" for x in key), f"seg {kinds[idx]}", "k bigint", "t double", *(f"`{x}` double" for x in channels)])
    return rows.repartition(*key).sortWithinPartitions(*key, idx).mapInArrow(whole_groups(key, work, STACK_ROWS // 4), types)


def _long_normalize(df: DataFrame, key: list[str], idx: str, t: str, channels: list[str], hz: float, smooth: float, size: int) -> DataFrame:
    d = split_at_stalls(increasing_times(df, key, idx, t, size), key, idx, t, size=size)
    d = staged(d.select(*key, idx, t, "seg", *channels), "normalise")
    start = d.groupBy(*key, "seg").agg(F.min(t).alias("_t0"), (F.max(t) - F.min(t)).alias("_dur"))
    d = spread_join(d, start, [*key, "seg"]).withColumns({"_i": F.col(idx) - F.col("seg"), "_rt": F.col(t) - F.col("_t0")})
    g = uniform_resample(d, [*key, "seg", "_t0"], "_i", "_rt", channels, hz, "_dur", size)
    back = int(round(smooth * hz))
    h = with_halo(g, "k", back, 0, size)
    w = W.partitionBy(*key, "seg", "_blk").orderBy("k").rowsBetween(-back, 0)
    h = h.withColumns({c: F.avg(c).over(w) for c in channels}).filter("_core")
    return h.select(*key, "seg", "k", (F.col("_t0") + F.col("grid_t")).alias("t"), *channels)


def sequence_gaps(df: DataFrame, key: list[str], idx: str, seq: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Running number of lost samples, modulo 65536 between neighbours."""
    d = neighbours(df, key, idx, {"_ps": seq}, size=size)
    d = d.withColumn("_lost", F.coalesce(F.pmod(F.col(seq) - F.col("_ps") - 1, F.lit(65536)), F.lit(0)).cast("long"))
    return block_scan(d, key, [idx], index_block(idx, size), [Scan("sequence_gaps", F.col("_lost"), "sum")]).drop("_ps", "_lost")


def greedy_chain(df: DataFrame, key: list[str], t: str, until: str, first: Column, block_s: float = 3600.0) -> DataFrame:
    """Rows picked one after another: the first with t >= ``first``, then always the first with
    t >= ``until`` of the row picked before. Times are distinct per key, and ``until`` does not decrease with them.
    """
    rows = df.select(*key, t, until, first.alias("_first"))
    return chain_blocks(rows, key, t, block_s, 0.0, lambda ts, block: (np.ones(len(ts), bool), block.column(until).to_numpy()))


def chain_blocks(rows: DataFrame, key: list[str], t: str, block_s: float, reach: float, links: Callable[[np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``greedy_chain`` in time blocks; ``rows`` has the key, ``t``, ``_first`` and what ``links`` needs.

    ``links(times, block)`` tells which of a block's rows may be picked and their ``until``, with ``reach`` seconds of rows
    ahead of the block to judge by. Each block is summarised by where it leaves off for every possible entry (its rows up to
    the first ``until``); composing these small maps in a tree gives the blocks' entries, then all blocks
    pick in parallel.
    """
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    by = [*key, "_blk"]
    d = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).withColumn("_core", F.floor(F.col(t) / block_s))
    d = d.withColumn("_blk", F.explode(F.sequence("_core", F.floor((F.col(t) + reach) / block_s)))).withColumn("_core", F.col("_core") == F.col("_blk"))
    d = d.repartition(*by)

    def chains(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        times, core = table.column(t).to_numpy(), table.column("_core").to_numpy()
        for a, z in zip(starts, [*starts[1:], len(times)]):
            ok, un = links(times[a:z], table.slice(a, z - a))
            ok = ok & core[a:z]
            if ok.any():
                ts, un = times[a:z][ok], un[ok]
                yield a, ts, un, np.searchsorted(ts, un - 1e-9)

    def summary(table: pa.Table, starts: np.ndarray) -> pa.Table:
        first, found, at, to = table.column("_first").to_numpy(), [], [], []
        for a, ts, un, nxt in chains(table, starts):
            m = min(max(1, int(np.searchsorted(ts, max(un[0], first[a]))) + 1), len(ts))
            now, go = np.arange(m), np.ones(m, bool)
            while go.any():
                go = (nxt[now] < len(ts)) & (nxt[now] > now)
                now = np.where(go, nxt[np.where(go, now, 0)], now)
            out = un[now]
            keep = np.r_[np.flatnonzero(np.diff(out)), m - 1]  # entries that lead elsewhere
            found.append(a)
            at.append(ts[keep])
            to.append(out[keep])
        return table.select([*by, "_first"]).take(pa.array(found, pa.int64())).append_column("_at", lists(at)).append_column("_to", lists(to))

    maps = d.sortWithinPartitions(*by, t).mapInArrow(whole_groups(by, summary, STACK_ROWS), f"{types}, _blk bigint, _first double, _at array<double>, _to array<double>")

    def leave(m: list[Any], state: Any) -> np.ndarray:
        at, to = (np.asarray(v, float) for v in m)
        pos = np.searchsorted(at, np.asarray(state, float) - 1e-9)
        return np.where(pos < len(at), to[np.minimum(pos, len(at) - 1)], state)

    def compose(a: list[Any], b: list[Any]) -> list[Any]:
        to = leave(b, a[1])
        last = np.r_[np.flatnonzero(np.diff(to)), len(to) - 1]  # entries that lead elsewhere
        later = np.asarray(b[0], float) > a[0][-1]  # an entry beyond the first block meets only the second
        return [np.r_[np.asarray(a[0], float)[last], np.asarray(b[0], float)[later]].tolist(), np.r_[to[last], np.asarray(b[1], float)[later]].tolist()]

    entries = block_entries(maps, key, "_blk", ["_at", "_to"], "_first", compose, lambda m, state: float(leave(m, state))).withColumnRenamed("entry", "_in")

    def pick(table: pa.Table, starts: np.ndarray) -> pa.Table:
        enter, found, picked = table.column("_in").to_numpy(), [], []
        for a, ts, _, nxt in chains(table, starts):
            i, nxt = int(np.searchsorted(ts, enter[a] - 1e-9)), nxt.tolist()
            while i < len(ts):
                found.append(a)
                picked.append(ts[i])
                i = nxt[i] if nxt[i] > i else i + 1
        return table.select(key).take(pa.array(found, pa.int64())).append_column(t, pa.array(picked, pa.float64()))

    return d.join(entries, by).sortWithinPartitions(*by, t).mapInArrow(whole_groups(by, pick, STACK_ROWS), f"{types}, `{t}` double")


def lists(parts: list[np.ndarray], null: bool = False) -> pa.ListArray:
    """One list per array; with ``null`` a NaN is a missing value."""
    offsets = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0), *parts]), pa.float64(), from_pandas=null))


def causal_emissions(df: DataFrame, key: list[str], t: str, window: float, hop: float, minimum: int = 16, keep: float = 0.25, span: float = 0.95, block_s: float = 600.0) -> DataFrame:
    """Times at which a live window is emitted: at least ``hop`` after the last one, ``minimum``
    samples held and ``span`` of the window covered. Anchored to the data, not to the epoch.

    The buffer holds the samples of the last ``window + keep`` seconds.
    """
    lag = int((window + keep) * 1e6)

    def ready(ts: np.ndarray, _: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        us = (ts * 1e6).astype(np.int64)
        old = np.searchsorted(us, us - lag)
        return (np.searchsorted(us, us, "right") - old >= minimum) & (ts - ts[old] >= span * window - 1e-9), ts + hop

    d = df.filter(F.col(t).isNotNull()).select(*key, F.col(t).cast("double").alias("t"), F.lit(-1e300).alias("_first"))
    return chain_blocks(d, key, "t", block_s, window + keep + 1e-6, ready)


def at_emissions(samples: DataFrame, emissions: DataFrame, key: list[str], t: str, cols: list[str], reach: float, names: list[str], cut: Callable[..., list[pa.Array]], block_s: float = 600.0) -> DataFrame:
    """One row per emission: key, ``now`` and the arrays ``names`` that ``cut`` makes of the samples up to ``reach`` seconds before it.

    Samples and emissions meet once in time blocks of a key, sorted by time; ``cut(times, values, last, windows)`` gets the sorted times
    and columns of many blocks, whether a sample is the last of its block, and (from, to, now) of each emission's samples.
    """
    c = F.col
    by, types = [*key, "_blk"], ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in key)
    known = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in key])
    rows = samples.filter(known & c(t).isNotNull()).select(*key, c(t).cast("double").alias("_t"), F.lit(False).alias("_e"), *[c(x).cast("double").alias(f"_c{i}") for i, x in enumerate(cols)])
    block = lambda at: F.floor(at / block_s)
    rows = rows.withColumn("_blk", F.explode(F.sequence(block(c("_t")), block(c("_t") + reach + 1e-6))))
    marks = emissions.filter(known).select(*key, c("t").alias("_t"), F.lit(True).alias("_e"), *[F.lit(None).cast("double").alias(f"_c{i}") for i in range(len(cols))], block(c("t")).alias("_blk"))
    both = rows.unionByName(marks).repartition(*by).sortWithinPartitions(*by, "_t", "_e")

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        marked = table.column("_e").to_numpy()
        kept = np.flatnonzero(~marked)
        times = table.column("_t").to_numpy()
        values = np.stack([table.column(f"_c{i}").to_numpy()[kept] for i in range(len(cols))], 1) if cols else np.empty((len(kept), 0))
        ends = np.r_[starts[1:], len(times)]
        a, z = np.searchsorted(kept, starts), np.searchsorted(kept, ends)  # each group's samples
        ts, last = times[kept], np.zeros(len(kept), bool)
        last[z[z > a] - 1] = True
        at = np.flatnonzero(marked)
        group, now = np.searchsorted(starts, at, "right") - 1, times[at]
        lo, hi = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        cuts = np.searchsorted(group, np.arange(len(starts) + 1))
        for g in np.unique(group).tolist():
            e, own = slice(cuts[g], cuts[g + 1]), ts[a[g]:z[g]]
            lo[e] = a[g] + np.searchsorted(own, now[e] - reach)
            hi[e] = a[g] + np.searchsorted(own, now[e], "right")
        good, arrays = cut(ts, values, last, (lo, hi, now))
        out = table.select(key).take(pa.array(at[good])).append_column("now", pa.array(now[good]))
        for n, x in zip(names, arrays):
            out = out.append_column(n, x)
        return out

    return both.mapInArrow(whole_groups(by, work, STACK_ROWS), ", ".join([types, "now double", *(f"`{n}` array<double>" for n in names)]))


def emission_windows(samples: DataFrame, emissions: DataFrame, key: list[str], t: str, window: float, channels: list[str] | None = None) -> DataFrame:
    """One row per emission with arrays of its samples of [emission - window, emission] in time order (``t`` and the ``channels``), with 1 ns of
    tolerance at the old end."""
    channels = channels or []

    def cut(ts: np.ndarray, values: np.ndarray, last: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
        lo, hi, _ = windows
        size = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        return np.ones(len(lo), bool), [pa.ListArray.from_arrays(offsets, pa.array(x[at], pa.float64(), from_pandas=True)) for x in (ts, *values.T)]

    return at_emissions(samples, emissions, key, t, channels, window + 1e-9, [t, *channels], cut)


def emission_grid(samples: DataFrame, emissions: DataFrame, key: list[str], idx: str, t: str, channels: list[str], window: float, fs: float, keep: float = 0.25,
                  size: int = BLOCK_ROWS) -> DataFrame:
    """One row per emission with each channel interpolated to now - window + k / fs (k = 1..n) as an array, ends clamped."""
    n = int(round(window * fs))
    nxt = {f"_n_{c}": c for c in ["_t", *channels]}
    d = neighbours(samples.select(*key, idx, F.col(t).alias("_t"), *channels), key, idx, {}, nxt, size)
    # a value next to a missing one is missing: the next sample may lie in a later block, so every sample knows
    gone = sum((F.when(F.col("_n__t").isNotNull() & F.col(f"_n_{c}").isNull(), 1 << i).otherwise(0) for i, c in enumerate(channels)), F.lit(0))
    d = d.select(*key, "_t", *channels, gone.alias("_gone"))
    ks = np.arange(1, n + 1)

    def cut(ts: np.ndarray, values: np.ndarray, last: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
        lo, hi, now = windows
        base = now - window
        at = np.empty((len(now), n), np.int64)
        good = np.zeros(len(now), bool)
        for e, (a, z, b) in enumerate(zip(lo.tolist(), hi.tolist(), base.tolist())):
            if z > a and (z - 1 == a or ts[z - 2] < now[e] - 1e-9):  # one sample alone ends the window
                own = np.ceil((ts[a:z] - b) * fs - 1e-6)
                at[e] = a + np.maximum(np.searchsorted(own, ks, "right") - 1, 0)
                good[e] = True
        at, base = at[good], base[good]
        t0, after = ts[at], np.minimum(at + 1, len(ts) - 1)
        t1 = np.where(last[at], t0, ts[after])
        when = np.maximum(base[:, None] + ks / fs, t0)
        moving = t1 != t0
        share = np.where(moving, (when - t0) / np.where(moving, t1 - t0, 1.0), 0.0)
        missing = np.nan_to_num(values[:, -1]).astype(np.int64)
        out = []
        for i in range(len(channels)):
            v = values[:, i]
            y = np.where(moving, v[at] + (np.where(moving, v[after], 0.0) - v[at]) * share, v[at])
            y[(missing[at] >> i) & 1 == 1] = np.nan
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(y.ravel(), pa.float64(), from_pandas=True)))
        return good, out

    return at_emissions(d, emissions, key, "_t", [*channels, "_gone"], window + keep, channels, cut)


def grid_rows(grid: DataFrame, channels: list[str]) -> DataFrame:
    """The rows of ``emission_grid``'s arrays, numbered ``k`` from 0."""
    rest = [c for c in grid.columns if c not in channels]
    return grid.select(*rest, F.posexplode(F.arrays_zip(*channels)).alias("k", "_v")).select(*rest, "k", *[F.col(f"_v.{c}").alias(c) for c in channels])


def stack(batch: pa.RecordBatch, columns: list[str], rows: np.ndarray, n: int) -> np.ndarray:
    """(windows, n, columns) of the array columns at ``rows``, each of ``n`` values; NaN is a missing one."""
    return np.stack([batch.column(c).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in columns], -1)


def window_features_v2(grid: DataFrame, key: list[str], axes: dict[str, str], fs: float, n: int, names: list[str] | None = None) -> DataFrame:
    """Second-generation features of interpolated emission windows; missing values are skipped, the dynamic part needs all."""
    names = K.V2_NAMES if names is None else names
    by = [*key, "now"]
    types = ", ".join(f"`{k}` {grid.schema[k].dataType.simpleString()}" for k in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STACK):
                b = whole.slice(a, STACK)
                x = stack(b, [axes[c] for c in AXES], np.arange(b.num_rows), n)
                full, found = np.isfinite(x).all((1, 2)), {c: np.empty(len(x)) for c in names}
                for some, kernel in ((full, K.v2), (~full, K.v2_gaps)):
                    if some.any():
                        for c, v in kernel(x[some], fs, names).items():
                            found[c][some] = v
                yield pa.record_batch([*[b.column(k) for k in by], *[pa.array(found[c], pa.float64(), from_pandas=True) for c in names]], names=[*by, *names])

    return grid.select(*by, *[axes[c] for c in AXES]).mapInArrow(run, ", ".join([types, *(f"`{c}` double" for c in names)]))


def window_features_live(windows: DataFrame, key: list[str], t: str, axes: dict[str, str], minimum: int) -> DataFrame:
    """First-generation live features of emission windows (rows of ``emission_windows``) with any number of samples from ``minimum`` on."""
    by = [*key, "now"]
    types = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in by)
    names = list(K.live(np.zeros((0, 2, 6)), np.zeros((0, 2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STACK):
                b = whole.slice(a, STACK)
                size = pc.list_value_length(b.column(t)).to_numpy()
                for n in np.unique(size[size >= minimum]).tolist():
                    at = np.flatnonzero(size == n)
                    found = K.live(stack(b, [axes[c] for c in AXES], at, n), stack(b, [t], at, n)[..., 0])
                    keys = [b.column(k).take(pa.array(at)) for k in by]
                    yield pa.record_batch([*keys, pa.array(np.full(len(at), n)), *[pa.array(found[c], pa.float64(), from_pandas=True) for c in names]], names=[*by, "samples", *names])

    return windows.mapInArrow(run, ", ".join([types, "samples bigint", *(f"`{c}` double" for c in names)]))


def gravity(df: DataFrame, key: list[str], idx: str, size: int = BLOCK_ROWS, warm: int = 800) -> DataFrame:
    """Adds g0..g2, the direction of gravity: a recursive mean of the usable acceleration directions.

    Rows without usable acceleration keep the last direction (straight up before the first). Usable rows are
    counted by themselves; the filter's memory fades by 0.94 a usable row, so a block that starts ``warm`` of them
    early has the same direction to the last bit that matters (0.94^800 < 1e-21).
    """
    c = F.col
    d = df.withColumn("_n", S.norm(c("ax"), c("ay"), c("az")))
    known = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in key])  # rows without a key have no filter
    usable = d.filter((c("_n") > 1e-6) & known).select(*key, idx, *[(c(a) / c("_n")).alias(f"_u{i}") for i, a in enumerate(("ax", "ay", "az"))], (c(idx) > 0).alias("_late"))
    h = with_halo(number_rows(usable, key, [idx], index_block(idx, size), "_k"), "_k", warm, 0, size)
    h = h.repartition(*key, "_blk").sortWithinPartitions(*key, "_blk", "_k")
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def follow(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        u = np.stack([rows.column(f"_u{i}").to_numpy() for i in range(3)], 1)
        fresh = (rows.column("_k").to_numpy()[starts] == 0) & rows.column("_late").to_numpy()[starts]
        g = filter_directions(u, starts, np.where(fresh[:, None], [0.0, 0.0, 1.0], u[starts]))
        out = rows.select([*key, idx])
        for i in range(3):
            out = out.append_column(f"g{i}", pa.array(g[:, i]))
        return out.filter(rows.column("_core"))

    g = h.mapInArrow(whole_groups([*key, "_blk"], follow, STACK_ROWS), f"{types}, `{idx}` {df.schema[idx].dataType.simpleString()}, g0 double, g1 double, g2 double")
    d = d.drop("_n").join(g.withColumn("_g", F.struct("g0", "g1", "g2")).drop("g0", "g1", "g2"), [*key, idx], "left")
    d = block_scan(d, key, [idx], index_block(idx, size), [Scan("_last", c("_g"), "last")])
    return d.withColumns({f"g{i}": F.coalesce(c(f"_last.g{i}"), F.lit(up)) for i, up in enumerate((0.0, 0.0, 1.0))}).drop("_g", "_last")


def filter_directions(u: np.ndarray, starts: np.ndarray, first: np.ndarray, few: int = 16) -> np.ndarray:
    """The gravity filter over runs of directions that begin at ``starts`` with the states ``first``.

    All runs take a step at a time; the last ``few`` long ones are followed one by one.
    """
    size = np.r_[starts[1:], len(u)] - starts
    order = np.argsort(-size, kind="stable")  # longest first
    starts, size, g, out = starts[order], size[order], first[order], np.empty_like(u)
    i = 0
    while (m := int(np.searchsorted(-size, -i, "left"))) > few:
        at = starts[:m] + i
        g[:m] = 0.94 * g[:m] + 0.06 * u[at]
        g[:m] /= np.maximum(np.sqrt((g[:m] * g[:m]).sum(1)), 1e-9)[:, None]
        out[at] = g[:m]
        i += 1
    for k in range(m):
        x, y, z = g[k].tolist()
        a, b = starts[k] + i, starts[k] + size[k]
        found = []
        for p, q, r in u[a:b].tolist():
            x, y, z = 0.94 * x + 0.06 * p, 0.94 * y + 0.06 * q, 0.94 * z + 0.06 * r
            n = max(math.sqrt(x * x + y * y + z * z), 1e-9)
            x, y, z = x / n, y / n, z / n
            found.append((x, y, z))
        out[a:b] = found
    return out


def orientation_fusion(df: DataFrame, key: list[str], idx: str, t: str, calibrating: str, size: int = BLOCK_ROWS, warm: int = 800) -> DataFrame:
    """Six-axis relative orientation (roll, pitch, yaw, q0..q3).

    Only the gravity filter is recursive (see ``gravity``); bias, baseline and yaw (a running sum) follow from it.
    Captures of up to ``size`` rows are worked on whole, many at a time, after one shuffle; longer ones, and rows without
    a key, in blocks. The quaternions are plain Spark expressions.
    """
    cols = [f.name for f in df.schema]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    named = df.filter(known)
    long = staged(named.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size).select(*key), "long")
    nameless = df.filter(~known)
    some_long, some_nameless = not long.isEmpty(), not nameless.isEmpty()
    d = _short_fusion(named.join(long, key, "left_anti") if some_long else named, key, idx, t, calibrating)
    if some_long or some_nameless:
        rest = nameless.unionByName(named.join(long, key, "left_semi")) if some_long else nameless
        d = d.unionByName(_long_fusion(rest, key, idx, t, calibrating, size, warm).select(*d.columns))
    return _oriented(d, cols, calibrating)


FUSED = ["g0", "g1", "g2", "_zg0", "_zg1", "_zg2", "_yaw"]


def _short_fusion(rows: DataFrame, key: list[str], idx: str, t: str, calibrating: str) -> DataFrame:
    """Adds ``FUSED`` (gravity, its direction at the end of calibration, yaw) to captures that one task can hold, as ``_long_fusion`` does."""

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        n = rows.num_rows
        stop = np.r_[starts[1:], n]
        owner = np.repeat(np.arange(len(starts)), stop - starts)

        def values(name: str) -> tuple[np.ndarray, np.ndarray]:
            column = rows.column(name).combine_chunks()
            return column.cast(pa.float64()).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)

        (x, xn), (y, yn), (z, zn) = (values(a) for a in ("ax", "ay", "az"))
        at, (time, unknown) = rows.column(idx).to_numpy(), values(t)
        cal = np.asarray(pc.fill_null(rows.column(calibrating), False))
        with np.errstate(invalid="ignore", over="ignore"):
            length = np.sqrt(x * x + y * y + z * z)
            usable = np.flatnonzero(~(xn | yn | zn) & ((length > 1e-6) | np.isnan(length)))
            u = np.stack([x, y, z], 1)[usable] / length[usable][:, None]
            turns = np.ones(len(usable), bool)
            turns[1:] = owner[usable][1:] != owner[usable][:-1]
            begin = np.flatnonzero(turns)
            up = np.array([0.0, 0.0, 1.0])
            followed = filter_directions(u, begin, np.where((at[usable[begin]] > 0)[:, None], up, u[begin]))
            place = np.full(n, -1)
            place[usable] = np.arange(len(usable))
            place = np.maximum.accumulate(place)  # unusable rows keep the last direction of their capture
            have = (place >= 0) & (owner[usable[place]] == owner) if len(usable) else np.zeros(n, bool)
            g = np.where(have[:, None], followed[place], up) if len(usable) else np.tile(up, (n, 1))

            gyro = [values(a) for a in ("gx", "gy", "gz")]
            bias, end = np.full((len(starts), 3), np.nan), np.full((len(starts), 3), np.nan)
            lacking, after, done = np.ones((len(starts), 3), bool), np.full(len(starts), -1), np.zeros(len(starts), bool)
            for k, (a, b) in enumerate(zip(starts.tolist(), stop.tolist())):
                still = a + np.flatnonzero(cal[a:b])
                if len(still):
                    done[k], after[k], end[k] = True, at[still[-1]] + 1, g[still[-1]]
                    for i, (v, null) in enumerate(gyro):
                        v = np.sort(v[still][~null[still]])
                        if len(v):
                            lacking[k, i], bias[k, i] = False, 0.5 * v[(len(v) - 1) // 2] + 0.5 * v[len(v) // 2]
            step = time - np.r_[np.nan, time[:-1]]
            step[starts] = np.nan
            step = np.maximum(0.0, np.fmin(0.1, step))  # without a time before, a tenth of a second
            step[done[owner] & (at == after[owner])] = 0.0
            rate = sum(((v - bias[owner, i]) * g[:, i] for i, (v, _) in enumerate(gyro[1:], 1)), (gyro[0][0] - bias[owner, 0]) * g[:, 0])
            skip = reduce(lambda p, q: p | q, [null | lacking[owner, i] for i, (_, null) in enumerate(gyro)])
            idle = np.asarray(pc.fill_null(rows.column(calibrating), True))  # neither turning nor unknown
            turn = np.where(idle, 0.0, rate * (math.pi / 180) * step)
            skip &= ~idle
            yaw, blank = np.empty(n), np.empty(n, bool)
            turn[skip] = 0.0
            for a, b in zip(starts.tolist(), stop.tolist()):
                np.cumsum(turn[a:b], out=yaw[a:b])
                blank[a:b] = np.logical_and.accumulate(skip[a:b])
        out = rows
        for name, v, null in [*((f"g{i}", g[:, i], None) for i in range(3)), *((f"_zg{i}", end[owner, i], ~done[owner]) for i in range(3)), ("_yaw", yaw, blank)]:
            out = out.append_column(name, pa.array(v, pa.float64(), mask=null))
        return out

    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{c}` double" for c in FUSED)])
    return rows.repartition(*key).sortWithinPartitions(*key, idx).mapInArrow(whole_groups(key, work, STACK_ROWS), types)


def _long_fusion(df: DataFrame, key: list[str], idx: str, t: str, calibrating: str, size: int, warm: int) -> DataFrame:
    """Adds ``FUSED`` to captures of any length, in blocks."""
    c = F.col
    d = staged(gravity(df, key, idx, size, warm), "gravity")
    cal = d.filter(calibrating)
    ends = cal.groupBy(*key).agg(*[F.percentile(x, F.lit(0.5)).alias(f"_b{x}") for x in ("gx", "gy", "gz")], *[F.max_by(x, idx).alias(f"_z{x}") for x in ("g0", "g1", "g2")], F.max(idx).alias("_ci"))
    d = spread_join(neighbours(d, key, idx, {"_pt": t}, size=size), ends, key)
    dt = F.when(c(idx) == c("_ci") + 1, 0.0).otherwise(S.clip(c(t) - c("_pt"), 0.0, 0.1))
    rate = (c("gx") - c("_bgx")) * c("g0") + (c("gy") - c("_bgy")) * c("g1") + (c("gz") - c("_bgz")) * c("g2")
    d = d.withColumn("_turn", F.when(~c(calibrating), F.radians(rate) * dt).otherwise(0.0))
    return block_scan(d, key, [idx], index_block(idx, size), [Scan("_yaw", c("_turn"), "sum")])


def _oriented(d: DataFrame, cols: list[str], calibrating: str) -> DataFrame:
    """Angles and quaternions from ``FUSED``."""
    c = F.col
    length = F.greatest(S.norm(c("_zg0"), c("_zg1"), c("_zg2")), F.lit(1e-9))
    d = d.withColumns({f"_zg{i}": c(f"_zg{i}") / length for i in range(3)})
    tilt = S.quat_between(tuple(c(f"_zg{i}") for i in range(3)), tuple(c(f"g{i}") for i in range(3)))
    d = d.withColumns({f"_t{i}": e for i, e in enumerate(tilt)})
    half = c("_yaw") / 2
    turn = (F.cos(half), *[c(f"_zg{i}") * F.sin(half) for i in range(3)])
    d = d.withColumns({f"_q{i}": e for i, e in enumerate(S.quat_product(turn, tuple(c(f"_t{i}") for i in range(4))))})
    unit = S.quat_normalise(tuple(c(f"_q{i}") for i in range(4)))
    d = d.withColumns({f"q{i}": F.when(c(calibrating), 1.0 if i == 0 else 0.0).otherwise(e) for i, e in enumerate(unit)})
    roll, pitch, yaw = S.euler_from_quat(tuple(c(f"q{i}") for i in range(4)))
    return d.withColumns({"roll_deg": roll, "pitch_deg": pitch, "yaw_deg": yaw}).select(*cols, "roll_deg", "pitch_deg", "yaw_deg", "q0", "q1", "q2", "q3")


def posture_calibrate(df: DataFrame, key: list[str], t: str, gyro: Column, seconds: float = 10.0, limit: float = 8.0, chunk_s: float = 600.0) -> DataFrame:
    """First calibration that succeeds per key: attempts, start, end and mean gyro.

    An attempt collects ``seconds`` and fails above ``limit``; the next starts with the next sample. Where an
    attempt ends does not depend on its success, so all attempts of a key are a chain that ``greedy_chain`` picks in
    parallel time blocks of ``chunk_s``; their means are one aggregation. No task sees more than a block.
    """
    c = F.col
    block = F.floor(c("t") / chunk_s)
    rows = staged(df.select(*key, c(t).alias("t"), gyro.alias("g")).withColumn("_blk", block), "calibrate")
    # an attempt ends with the first sample ``seconds`` after its start: in the start's block or just behind it ...
    copies = rows.withColumn("_core_blk", c("_blk")).withColumn("_blk", F.explode(F.sequence(F.floor((c("t") - seconds) / chunk_s), c("_core_blk"))))
    ahead = W.partitionBy(*key, "_blk").orderBy(F.round(c("t") * 1e6).cast("long")).rangeBetween(int(seconds * 1e6), W.unboundedFollowing)
    near = copies.withColumn("_near", F.min("t").over(ahead)).filter("_blk = _core_blk").drop("_core_blk")
    # ... or, after a stall, with the first sample of a later block
    late = F.min(F.when(c("t") > c("_blk") * chunk_s + seconds, c("t")))
    blocks = rows.groupBy(*key, "_blk").agg(F.min("t").alias("_t0"), late.alias("_t1"))
    w = W.partitionBy(*key).orderBy("_blk")
    beyond = F.when(F.lead("_blk").over(w) == c("_blk") + 1, F.coalesce(F.lead("_t1").over(w), F.lead("_t0", 2).over(w))).otherwise(F.lead("_t0").over(w))
    d = near.join(blocks.withColumn("_far", beyond).select(*key, "_blk", "_far"), [*key, "_blk"])
    d = d.withColumn("end", F.coalesce("_near", "_far")).filter("end IS NOT NULL").select(*key, "t", "end")
    d = staged(d.withColumn("until", c("end") + 2e-9 + F.abs("end") * 4.5e-16), "attempts")  # the next attempt starts after that sample
    starts = greedy_chain(d.drop("end"), key, "t", "until", F.lit(-1e300), chunk_s)
    tries = starts.join(d, [*key, "t"]).select(*key, c("t").alias("start"), "end")
    held = interval_join(rows.drop("_blk"), tries, key, "t", "start", "end", max(seconds, 1.0), F.lit(True))
    means = held.groupBy(*key, "start", "end").agg(F.avg("g").alias("mean_gyro"))
    good = F.when(c("mean_gyro") <= limit, c("start"))
    first = means.groupBy(*key).agg(F.min_by(F.struct("start", "end", "mean_gyro"), good).alias("_f"), F.min(good).alias("_s"))
    count = means.join(first.select(*key, "_s"), key).groupBy(*key).agg(F.count_if(c("_s").isNull() | (c("start") <= c("_s"))).cast("int").alias("attempts"))
    out = rows.select(*key).distinct().join(first, key, "left").join(count, key, "left")
    return out.select(*key, c("_s").isNotNull().alias("ok"), *[F.when(c("_s").isNotNull(), c(f"_f.{n}")).alias(n) for n in ("start", "end", "mean_gyro")], F.coalesce("attempts", F.lit(0)).alias("attempts"))


def posture_monitor(df: DataFrame, key: list[str], idx: str, machine: Any, size: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Batch twin of the posture stream: (windows, events) of samples and commands (``streaming.scoring.Posture`` names the columns and numbers).

    A ``calibrate`` command starts a new epoch. Within an epoch the first calibration that succeeds gives the baseline; what lies
    before it is left out. Windows, limits and episodes are relations; an unsure window is a NULL label, which
    keeps the active one.
    """
    m, c, by = machine, F.col, [*key, "epoch"]
    d = block_scan(df, key, [m.t, idx], F.floor(c(m.t) / 600), [Scan("epoch", F.when(c("command") == "calibrate", 1).otherwise(0).cast("long"), "sum")])
    d = d.filter("command IS NULL OR command = ''").withColumn("_hard", F.coalesce(c("source").startswith("hardware"), F.lit(False)) & c("roll").isNotNull() & c("pitch").isNotNull() & c("yaw").isNotNull())
    d = staged(d.withColumnRenamed(m.t, "_t"), "epochs")
    good = posture_calibrate(d, by, "_t", S.norm(c("gx"), c("gy"), c("gz")), m.seconds, m.still).filter("ok").select(*by, "start", c("end").alias("_end"))
    d = spread_join(d, good, by, "inner").filter("_t >= start").withColumn("calibrating", c("_t") <= c("_end"))
    d = staged(number_rows(d, by, ["_t", idx], F.floor(c("_t") / 600), "_j"), "posture")
    soft = staged(number_rows(d.filter("NOT _hard"), by, ["_j"], index_block("_j", size), "_s"), "fused")
    soft = staged(orientation_fusion(soft, by, "_s", "_t", "calibrating", size), "orientation").select(*by, "_j", *[c(f"{a}_deg").alias(f"_f{a}") for a in ("roll", "pitch", "yaw")], *[c(f"q{i}").alias(f"_fq{i}") for i in range(4)])
    built = S.quat_from_euler(c("roll"), c("pitch"), c("yaw"))
    d = d.join(soft, [*by, "_j"], "left")
    d = d.withColumns({**{f"q{i}": F.when(c("_hard"), q).otherwise(c(f"_fq{i}")) for i, q in enumerate(built)}, **{a: F.when(c("_hard"), c(a)).otherwise(c(f"_f{a}")) for a in ("roll", "pitch", "yaw")}})
    quats = [f"q{i}" for i in range(4)]
    cols = [*AXIS_NAMES, "roll", "pitch", "yaw", *quats]
    d = staged(d.select(*by, "_j", "_t", "_hard", "calibrating", *cols), "oriented")
    base = staged(neutral_baseline(d.filter("calibrating"), by, ["ax", "ay", "az"], ["roll", "pitch", "yaw"], quats), "baseline")
    live = staged(number_rows(d.filter("NOT calibrating"), by, ["_j"], index_block("_j", size), "_k"), "watched")
    e = staged(causal_emissions(live, by, "_t", m.window, m.hop), "emissions")
    g = staged(grid_rows(emission_grid(live, e, by, "_k", "_t", cols, m.window, m.fs), cols), "grid")
    n = int(round(m.window * m.fs))
    grid = spread_join(g, base, by, "inner").withColumns({**{f"_b_{a}": c(f"base_{a}") for a in ("ax", "ay", "az", "roll", "pitch", "yaw")}, **{f"_b_{q}": F.get("base_quat", F.lit(i)) for i, q in enumerate(quats)}})
    names = ["ax", "ay", "az", "roll", "pitch", "yaw", *quats]
    wanted = sorted({*m.model.features, "relative_roll_mean", "relative_pitch_mean", "relative_yaw_mean", "gyro_mean_dps", "dynamic_acc_std_g"})
    f = kernel_windows(grid, [*by, "now"], "k", [*cols, *[f"_b_{a}" for a in names]], n, n, wanted, lambda x: K.posture(x[..., :13], {a: x[:, 0, 13 + i] for i, a in enumerate(names)}, m.fs), size, 13)
    f = staged(f.drop("win"), "features")
    f = f.join(live.select(*by, c("_t").alias("now"), "_hard"), [*by, "now"])
    p = m.model.columns()
    f = staged(f.withColumns(p), "scored").withColumn("confidence", F.greatest(*[c(x) for x in m.model.classes]))
    predicted = F.coalesce(*[F.when(c(x) == c("confidence"), x) for x in m.model.classes])
    beyond = F.array_compact(F.array(*[F.when((F.abs(c(f"relative_{a}_mean")) >= m.limit) & (F.lit(a != "yaw") | c("_hard")), name) for name, a in (("head_pitch", "pitch"), ("head_tilt", "roll"), ("head_turn", "yaw"))]))
    rows = f.select(*by, "now", predicted.alias("predicted"), "confidence", ((c("gyro_mean_dps") <= m.calm[0]) & (c("dynamic_acc_std_g") <= m.calm[1])).alias("stable"), F.array_join(beyond, ",").alias("deviations"),
                    *[c(f"relative_{a}_mean").alias(a) for a in ("roll", "pitch", "yaw")], F.when(c("_hard"), "reliable").otherwise("degraded").alias("yaw_reliability"))
    rows = rows.withColumn("predicted_state", F.when((c("predicted") != "normal") | (c("deviations") != ""), "poor").otherwise("normal"))
    rows = staged(number_rows(rows, by, ["now"], F.floor(c("now") / 600), "_w"), "windows")
    lab = F.when((c("confidence") >= m.threshold) & c("stable"), c("predicted_state"))
    held = debounce_hold(rows.select(*by, "_w", "now", lab.alias("lab")), by, "_w", "now", "lab", m.on, m.off)
    none = F.lit(None).cast("double")
    began = held.select(*key, F.lit("posture_started").alias("kind"), c("label").alias("posture"), c("started_at").alias("at"), none.alias("duration_seconds"))
    ended = held.filter("ended_at IS NOT NULL").select(*key, F.lit("posture_ended").alias("kind"), c("label").alias("posture"), c("ended_at").alias("at"), c("duration_s").alias("duration_seconds"))
    return rows.drop("_w", "epoch"), began.unionByName(ended)


def quiet_episodes(df: DataFrame, key: list[str], idx: str, t: str, level: Column, size: int = BLOCK_ROWS) -> DataFrame:
    """Cut a probability stream where the workout policy is certainly idle; adds ``episode``.

    After quiet rows (``level`` below the continue threshold) lasting the workout timeout, one row ends
    a running action and the next one the session, so from the third such row on the policy is in its
    initial state whatever came before. Later rows of that quiet stretch cannot change it and are
    left out. Episodes are independent and as short as a workout.
    """
    c = F.col
    d = df.withColumn("_quiet", level < WK.CONTINUE)
    d = block_scan(d, key, [idx], index_block(idx, size), [Scan("_q0", F.when(~c("_quiet"), c(idx)), "last")])
    d = d.withColumn("_run", F.when(c("_quiet"), F.coalesce(c("_q0"), F.lit(-1)) + 1))
    first = neighbours(d, key, idx, {"_pr": "_run"}, size=size)
    first = block_scan(first, key, [idx], index_block(idx, size), [Scan("_t0", F.when(c("_run").isNotNull() & ((c("_pr") != c("_run")) | c("_pr").isNull()), c(t)), "last")])
    first = first.withColumn("_late", c("_run").isNotNull() & (c(t) - c("_t0") >= WK.TIMEOUT))
    h = with_halo(first, idx, 3, 0, size)
    w = W.partitionBy(*key, "_blk").orderBy(idx)
    cut = c("_late") & F.coalesce(F.lag("_late", 2).over(w), F.lit(False)) & (F.lag("_run", 2).over(w) == c("_run")) & ~F.coalesce(
        F.lag("_late", 3).over(w) & (F.lag("_run", 3).over(w) == c("_run")), F.lit(False))
    idle = c("_late") & F.lag("_late", 3).over(w) & (F.lag("_run", 3).over(w) == c("_run"))  # changes nothing in the initial state
    h = h.withColumns({"_cut": F.when(F.coalesce(cut, F.lit(False)), c(idx)), "_idle": F.coalesce(idle, F.lit(False))})
    h = h.filter("_core AND NOT _idle").drop("_blk", "_core", "_idle")
    d = block_scan(h, key, [idx], index_block(idx, size), [Scan("episode", c("_cut"), "last")])
    return d.withColumn("episode", F.coalesce("episode", F.lit(0))).drop("_quiet", "_q0", "_run", "_pr", "_t0", "_late", "_cut")


WORKOUT_SCHEMA = ("type string, session_id string, timestamp double, action string, start_timestamp double, end_timestamp double, duration_seconds double, confidence double, sets int")


def workout_events(df: DataFrame, key: list[str], idx: str, t: str, classes: list[str], strength: list[str], poor: str | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """Workout policy events of probability rows (one column per motion class)."""
    level = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    d = quiet_episodes(df.select(*key, idx, F.col(t).alias("_time"), *classes, *([F.col(poor).alias("_poor")] if poor else [F.lit(False).alias("_poor")])), key, idx, "_time", level, size)
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def run(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        policy = WK.Workout(classes, strength, "|".join(str(v) for v in group[:-1]))
        time = pdf["_time"].to_numpy(float)
        out = policy.advance(time, pdf[classes].to_numpy(float), pdf["_poor"].to_numpy(bool)) + policy.flush(float(time[-1]))
        frame = pd.DataFrame(out, columns=WK.WORKOUT_EVENT)
        for k, v in zip(reversed(key), reversed(group[:-1])):
            frame.insert(0, k, v)
        return frame

    return d.groupBy(*key, "episode").applyInPandas(run, f"{types}, {WORKOUT_SCHEMA}")
