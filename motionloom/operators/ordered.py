"""Ordered operators over keyed rows, done in bounded blocks.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. One device can hold a
third of all rows, so nothing here does that. Each key's order is cut into blocks instead:

* ``block_scan``   running sum/min/max/last over a whole key: window inside the block plus the
                   carry of all earlier blocks (a window over block totals, one row per block);
* ``with_halo``    bounded frames (lag, lead, rolling): rows near a block edge are copied to the
                   neighbouring block, so each (key, block) can be computed alone;
* ``spread_join``  rows to one-row-per-key tables with the hot keys salted (``large``: tables that grow like the rows);
* ``block_entries`` the state in which a recursion enters each block, by composing the blocks' maps in a tree;
* ``exact_percentile`` rank selection over distinct values in even ranges, never one task per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

BLOCK_ROWS = 1 << 17
SALTS = 16
LARGE_SALTS = 4
#: Rows of whole groups that an Arrow kernel takes at a time, at least.
STACK_ROWS = 1 << 18


@dataclass(frozen=True)
class Scan:
    """One running value: ``how`` is sum, min, max or last (last non-null)."""

    name: str
    expr: Column
    how: str = "sum"
    inclusive: bool = True
    reverse: bool = False


def _fold(how: str, expr: Column) -> Column:
    if how == "last":
        return F.last(expr, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[how](expr)


def block_scan(df: DataFrame, key: list[str], order: list[str], block: Column, scans: list[Scan]) -> DataFrame:
    """Add running values over ``order`` within ``key``.

    ``block`` must be monotone in ``order`` (an hour of a timestamp, ``idx div n``); it only
    decides how the work is split, never the result. ``order`` must be total.
    """
    rows = df.withColumn("_blk", block)
    by = [*key, "_blk"]
    position = F.struct(*order)
    totals, carries, columns = [], {}, {}
    for s in scans:
        n = f"_t_{s.name}"
        if s.how == "last":
            at = F.when(s.expr.isNotNull(), position)
            totals.append((F.min_by if s.reverse else F.max_by)(s.expr, at).alias(n))
        else:
            totals.append(_fold(s.how, s.expr).alias(n))
        over = W.partitionBy(*key).orderBy(F.col("_blk").desc() if s.reverse else F.col("_blk").asc())
        carries[f"_c_{s.name}"] = _fold(s.how, F.col(n)).over(over.rowsBetween(W.unboundedPreceding, -1))
        sort = [F.col(c).desc() if s.reverse else F.col(c).asc() for c in order]
        inside = W.partitionBy(*by).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1)
        columns[s.name] = _fold(s.how, s.expr).over(inside)
    carry = rows.groupBy(*by).agg(*totals).withColumns(carries).select(*by, *carries)
    out = rows.withColumns(columns).join(carry, by, "left")
    merged = {}
    for s in scans:
        here, before = F.col(s.name), F.col(f"_c_{s.name}")
        if s.how == "sum":
            merged[s.name] = F.when(here.isNull() & before.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
        elif s.how == "last":
            merged[s.name] = F.coalesce(here, before)
        else:
            merged[s.name] = (F.least if s.how == "min" else F.greatest)(here, before)
    return out.withColumns(merged).drop("_blk", *carries)


def number_rows(df: DataFrame, key: list[str], order: list[str], block: Column, out: str = "idx") -> DataFrame:
    """0-based position of each row within its key."""
    numbered = block_scan(df, key, order, block, [Scan(out, F.lit(1).cast("long"), "sum")])
    return numbered.withColumn(out, F.col(out) - 1)


def index_block(idx: str = "idx", size: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(idx) / F.lit(size))


def with_halo(df: DataFrame, idx: str, before: int, after: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Copy rows to every block that needs them; adds ``_blk`` and ``_core``.

    A block keeps its own rows (``_core``) and sees ``before`` rows ahead of its first and
    ``after`` rows beyond its last one.
    """
    i, n = F.col(idx), F.lit(size)
    first = F.greatest(F.floor((i - after) / n), F.lit(0))
    return df.withColumn("_blk", F.explode(F.sequence(first, F.floor((i + before) / n)))).withColumn(
        "_core", F.col("_blk") == F.floor(i / n))


def block_window(key: list[str], idx: str = "idx") -> W:
    return W.partitionBy(*key, "_blk").orderBy(idx)


def keep_core(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_blk", "_core")


def neighbours(df: DataFrame, key: list[str], idx: str, lags: dict[str, str], leads: dict[str, str] | None = None,
               size: int = BLOCK_ROWS) -> DataFrame:
    """lag/lead by one row: ``{new: old}``."""
    leads = leads or {}
    w = block_window(key, idx)
    h = with_halo(df, idx, 1 if lags else 0, 1 if leads else 0, size)
    h = h.withColumns({**{new: F.lag(old).over(w) for new, old in lags.items()},
                       **{new: F.lead(old).over(w) for new, old in leads.items()}})
    return keep_core(h)


def islands(df: DataFrame, key: list[str], idx: str, change: Column, out: str = "island",
            size: int = BLOCK_ROWS) -> DataFrame:
    """Id of the run each row belongs to: the index of the last row where ``change`` holds."""
    start = Scan(out, F.when(change, F.col(idx)), "last")
    return block_scan(df, key, [idx], index_block(idx, size), [start])


def spread_join(rows: DataFrame, per_key: DataFrame, key: list[str], how: str = "left", salts: int | None = None, large: bool = False) -> DataFrame:
    """Join rows to a per-key table, spreading each key over ``salts`` tasks.

    The salt is a hash of the row, so a recomputed task after a lost executor salts as before. Spark judges the
    size of ``per_key`` before its rows are copied for the salts, so a ``large`` one (about as many keys as rows)
    is always shuffled, never broadcast through the driver, and copied less.
    """
    salts = salts or (LARGE_SALTS if large else SALTS)
    hashable = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge") if large else copies, [*key, "_salt"], how).drop("_salt")


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row tables with different columns into one row, without a join."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def in_ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """The rows cut into ranges of ``order``, with the number of each row's range as ``_bin``, written once.

    Spark samples the rows to place the cuts, so the ranges are even whatever the shape of the values, and
    one key may span any number of them. ``_bin`` is monotone in ``order``. Rows equal in ``order`` stay
    together: count them first. ``parts`` fixes the number of ranges; by default Spark sizes them.
    """
    cut = df.repartitionByRange(*([parts] if parts else []), *order)
    return staged(cut.withColumn("_bin", F.spark_partition_id()), "ranges")


def exact_percentile(df: DataFrame, key: list[str], value: str, points: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles per key (numpy's default rule), one row per key.

    Equal values are counted first, so copies cost nothing; the counted values are cut into even
    ranges, running counts over the ranges find those that hold a wanted rank, and only these are
    sorted. No task ever holds all values of a key.
    """
    if not key:
        return exact_percentile(df.withColumn("_all", F.lit(0)), ["_all"], value, points, parts).drop("_all")
    v = F.col(value)
    real = v.isNotNull() & ~F.isnan(v) if dict(df.dtypes)[value] in ("double", "float") else v.isNotNull()
    counts = df.filter(real).groupBy(*key, v.alias("_v")).agg(F.count(F.lit(1)).alias("_rows"))
    ranged = in_ranges(counts, [*key, "_v"], parts)
    here, upto = F.sum("_rows").over(W.partitionBy(*key)), F.sum("_rows").over(W.partitionBy(*key).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    totals = ranged.groupBy(*key, "_bin").agg(F.sum("_rows").alias("_rows")).select(*key, "_bin", here.alias("_n"), upto.alias("_upto"), (upto - F.col("_rows")).alias("_before"))
    ranks = {name: (F.col("_n") - 1) * F.lit(p) for name, p in points.items()}
    wanted = [(F.col("_before") <= end(at)) & (F.col("_upto") > end(at)) for at in ranks.values() for end in (F.floor, F.ceil)]
    held = ranged.join(totals.filter(reduce(lambda a, b: a | b, wanted)), [*key, "_bin"])
    cum = held.withColumn("_cum", F.col("_before") + F.sum("_rows").over(W.partitionBy(*key, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    picks = []
    for name, at in ranks.items():
        picks.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi_{name}"))
    found = cum.groupBy(*key, "_n").agg(*picks)
    result = []
    for name, at in ranks.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*key, *result)


def block_entries(blocks: DataFrame, key: list[str], seq: str, maps: list[str], first: str, compose: Callable[[list[Any], list[Any]], list[Any]], enter: Callable[[list[Any], Any], Any],
                  fan: int = 64) -> DataFrame:
    """(key, seq, entry): the state before each block of a recursion that starts with ``first``.

    A block (whole number ``seq``, distinct per key) is a map of states, held in the columns ``maps``;
    ``compose(earlier, later)`` is the map of two blocks together and ``enter(map, state)`` what a block makes of a
    state. ``fan`` neighbours become one map, level by level, until each key has one; then every level hands the
    entries down. No task or row holds more than ``fan`` maps, and the work is linear in the blocks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    types = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    level = staged(blocks.select(*key, F.col(seq).cast("long").alias("_seq"), *maps, F.col(first).alias("_first")), "maps")
    least = level.agg(F.min("_seq")).first()[0] or 0  # counted from zero, so that all of a key meet in one group in the end
    level = level.withColumn("_seq", F.col("_seq") - least)
    start = staged(level.groupBy(*key).agg(F.min_by("_first", "_seq").alias("_entry")), "entries")
    levels = [level]

    def fold(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.sort_values("_seq")[maps].itertuples(index=False, name=None)
        whole = reduce(compose, (list(p) for p in parts))
        return pd.DataFrame([[*group, *whole]], columns=[*key, "_seq", *maps])

    def walk(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        state, out = pdf["_entry"].iloc[0], []
        for m in pdf[maps].itertuples(index=False, name=None):
            out.append(state)
            state = enter(list(m), state)
        res = pdf[[*key, "_seq"]].copy()
        res["_entry"] = out
        return res

    up = F.floor(F.col("_seq") / fan).alias("_seq")
    while levels[-1].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        folded = levels[-1].groupBy(*key, up).applyInPandas(fold, f"{types}, _seq long, " + ", ".join(f"`{m}` {kinds[m]}" for m in maps))
        levels.append(staged(folded, "maps"))
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])
    top = levels.pop()
    entries = top.join(start, same(top, start, key)).select(*[top[k] for k in key], top["_seq"], "_entry")
    while levels:
        low, high = levels.pop().withColumn("_up", up), entries.withColumnRenamed("_seq", "_up")
        met = low.join(high, same(low, high, [*key, "_up"])).select(*[low[k] for k in key], low["_seq"], low["_up"], *[low[m] for m in maps], "_entry")
        entries = staged(met.groupBy(*key, "_up").applyInPandas(walk, f"{types}, _seq long, _entry {kinds[first]}"), "entries")
    return entries.withColumn("_seq", F.col("_seq") + least).withColumnsRenamed({"_seq": seq, "_entry": "entry"})


def whole_groups(by: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], least: int = STACK_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` on rows sorted by ``by``: ``work(rows, starts)`` gets many whole groups of ``least`` rows or more at a time and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, enough = [], 0, least
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= enough:
                rows = pa.Table.from_batches(held).combine_chunks()
                starts = group_starts(rows, by)
                if starts[-1]:  # the last group may go on in the next batch
                    yield from work(rows.slice(0, starts[-1]), starts[:-1]).to_batches(512)
                rest = rows.slice(starts[-1])
                held, count = rest.to_batches(), rest.num_rows
                enough = max(least, 2 * count)
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            rows = rows.combine_chunks()
            yield from work(rows, group_starts(rows, by)).to_batches(512)

    return run


def group_starts(rows: pa.Table, by: list[str]) -> np.ndarray:
    """Where the runs of equal ``by`` begin in sorted rows of one chunk."""
    turns = np.zeros(rows.num_rows, bool)
    turns[0] = True
    for c in by:
        codes = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        turns[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(turns)
