"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motionloom.session import staged

#: Tables of the index, rows that a bucket should hold, and rows that meet in one group.
TABLES, BUCKET_ROWS, CELL_ROWS = 4, 32, 8192
#: Buckets probed in a table of b buckets: PROBES[0] * b ** PROBES[1].
PROBES = (2.2, 0.65)
#: A cell is split if it holds more than this share of the rows (and more than two cells should), so at most TABLES / HOT_SHARE cells are.
HOT_SHARE = 1 / 50_000
ROTATIONS, CHUNK = 3, 256

ENCODED = "dim int, tab int, cell long, code long, id long, vec array<{}>"
PROBED = "dim int, tab int, cell long, codes array<long>, id long, vec array<{}>"
FOUND = "query_id long, vec_id long, score double"


def padded(dim: int) -> int:
    return max(2, 1 << (dim - 1).bit_length())


def functions(rows: int, dim: int) -> list[int]:
    """Axes used by each hash function of a table: the last is narrowed so that a bucket holds about BUCKET_ROWS."""
    n, want = padded(dim), rows / BUCKET_ROWS
    axes, buckets = [n], 2 * n
    while buckets < want:
        axes.append(1)
        buckets *= 2
        while buckets < want and axes[-1] < n:
            axes[-1], buckets = axes[-1] * 2, buckets * 2
    return axes


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """A pseudo-random rotation: random signs and a fast Hadamard transform, three times."""
    rng, n = np.random.default_rng(seed), x.shape[1]
    for _ in range(ROTATIONS):
        x, half = x * rng.choice([-1.0, 1.0], n), 1
        while half < n:
            pair = x.reshape(len(x), -1, 2, half)
            x, half = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], 2).reshape(len(x), n), half * 2
        x = x / math.sqrt(n)
    return x


def signed_axes(vectors: np.ndarray, tab: int, axes: list[int]) -> list[np.ndarray]:
    """Per hash function, how near each unit vector is to every signed axis (the inner product with it)."""
    n = padded(vectors.shape[1])
    vectors = vectors.astype(float)
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit = np.pad(unit / np.linalg.norm(unit, axis=1, keepdims=True), ((0, 0), (0, n - vectors.shape[1])))
    turned = [rotate(unit, (n, tab, k))[:, :a] for k, a in enumerate(axes)]
    return [np.concatenate([t, -t], 1) for t in turned]


def bucket(near: list[np.ndarray]) -> np.ndarray:
    code = np.zeros(len(near[0]), np.int64)
    for s in near:
        code = code * s.shape[1] + s.argmax(1)
    return code


def probes(near: list[np.ndarray], count: int) -> np.ndarray:
    """The ``count`` buckets of least penalty for each vector: squared shortfalls from the nearest axis, summed over the functions.

    Only the best prefixes can be part of the best buckets, so no more than ``count`` are kept after each function.
    """
    codes, cost = np.zeros((len(near[0]), 1), np.int64), np.zeros((len(near[0]), 1))
    for s in near:
        short = (s.max(1, keepdims=True) - s) ** 2
        cost = (cost[:, :, None] + short[:, None, :]).reshape(len(s), -1)
        codes = (codes[:, :, None] * s.shape[1] + np.arange(s.shape[1])).reshape(len(s), -1)
        if cost.shape[1] > count:
            best = np.argpartition(cost, count - 1, axis=1)[:, :count]
            codes, cost = np.take_along_axis(codes, best, 1), np.take_along_axis(cost, best, 1)
    return codes


def lists(flat: np.ndarray, lengths: np.ndarray | int, count: int) -> pa.Array:
    lengths = np.full(count, lengths) if np.isscalar(lengths) else lengths
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of each vector length; vectors travel in the element type that they came in."""
    ids, vec = batch.column("id").to_numpy(), batch.column("vec")
    sizes, values = vec.value_lengths().to_numpy(), vec.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield ids[at], values[starts[at][:, None] + np.arange(d)]


class Index:
    """The hash functions for a counted table; the same in every task."""

    def __init__(self, rows: int):
        self.rows, self.cells = rows, max(1, math.ceil(rows / CELL_ROWS))

    def layout(self, dim: int) -> tuple[list[int], int]:
        axes = functions(self.rows, dim)
        return axes, math.prod(2 * a for a in axes)

    def cell(self, codes: np.ndarray, buckets: int) -> np.ndarray:
        """Neighbouring codes share their first axes; a cell is a stretch of codes."""
        return codes // max(1, -(-buckets // self.cells))

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in by_dimension(batch):
                axes, buckets = self.layout(x.shape[1])
                for tab in range(TABLES):
                    code = bucket(signed_axes(x, tab, axes))
                    yield pa.record_batch([np.full(len(ids), x.shape[1], np.int32), np.full(len(ids), tab, np.int32), self.cell(code, buckets), code, ids, lists(x.ravel(), x.shape[1], len(ids))],
                                          names=["dim", "tab", "cell", "code", "id", "vec"])

    def probe(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every cell that one of its probes lies in, with the probed codes there."""
        for batch in batches:
            for all_ids, all_x in by_dimension(batch):
                axes, buckets = self.layout(all_x.shape[1])
                count = min(buckets, math.ceil(PROBES[0] * buckets ** PROBES[1]))
                step = max(1, (1 << 23) // (count * 2 * padded(all_x.shape[1])))
                for a in range(0, len(all_ids), step):
                    ids, x = all_ids[a : a + step], all_x[a : a + step]
                    for tab in range(TABLES):
                        codes = np.sort(probes(signed_axes(x, tab, axes), count), axis=1)
                        cell = self.cell(codes, buckets)
                        first = np.ones(cell.shape, bool)
                        first[:, 1:] = cell[:, 1:] != cell[:, :-1]
                        at = np.flatnonzero(first.ravel())
                        who = at // codes.shape[1]
                        yield pa.record_batch([np.full(len(at), x.shape[1], np.int32), np.full(len(at), tab, np.int32), cell.ravel()[at], lists(codes.ravel(), np.diff(np.r_[at, codes.size]), len(at)), ids[who], lists(x[who].ravel(), x.shape[1], len(at))],
                                              names=["dim", "tab", "cell", "codes", "id", "vec"])


class Group:
    """The rows of one part of a cell, in the order of their codes; of equal vectors only the ids that can be among the nearest."""

    def __init__(self, code: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((ids, *x.T, code))
        code, ids, x = code[order], ids[order], x[order]
        new = np.r_[True, (code[1:] != code[:-1]) | (x[1:] != x[:-1]).any(1)] if len(ids) else np.ones(0, bool)
        again = np.r_[False, (ids[1:] == ids[:-1]) & ~new[1:]] if len(ids) else new
        code, ids, x, new = code[~again], ids[~again], x[~again], new[~again]
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        keep = place <= k
        self.code, self.ids, self.x, self.k = code[keep], ids[keep], x[keep], k

    def nearest(self, query: int, q: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if codes is None:
            at = np.arange(len(self.ids))
        else:
            low, high = np.searchsorted(self.code, codes), np.searchsorted(self.code, codes, "right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        at = at[self.ids[at] != query]
        d = np.sqrt(((self.x[at] - q) ** 2).sum(1))
        if len(at) > self.k:
            cut = d <= np.partition(d, self.k - 1)[self.k - 1]
            at, d = at[cut], d[cut]
        best = np.lexsort((self.ids[at], d))[: self.k]
        return self.ids[at][best], d[best]


def search(k: int):
    """Answers the queries of each part of a cell; its rows come first and stay in memory, queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group = None, [], None
        for batch in batches:
            n = batch.num_rows
            keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("dim", "tab", "cell", "part")], 1)
            asks, ids = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            code, vec, codes = batch.column("code").to_numpy(zero_copy_only=False), batch.column("vec"), batch.column("codes")
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])]) if n else []
            for a, b in zip(cuts, [*cuts[1:], n]):
                if key is None or (keys[a] != key).any():
                    key, held, group = keys[a], [], None
                x = vec.slice(a, b - a).flatten().to_numpy().reshape(b - a, int(key[0])).astype(float)
                if not asks[a]:
                    held.append((code[a:b].astype(np.int64), ids[a:b], x))
                    continue
                if not held:
                    continue
                if group is None:
                    group = Group(*(np.concatenate(p) for p in zip(*held)), k)
                found = [group.nearest(ids[i], x[i - a], codes[i].values.to_numpy() if codes[i].is_valid else None) for i in range(a, b)]
                sizes = [len(f[0]) for f in found]
                yield pa.record_batch([np.repeat(ids[a:b], sizes), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], names=["query_id", "vec_id", "score"])

    return run


def usable(df: DataFrame, id_: str, vec: str) -> DataFrame:
    """(id, vec) of the rows with an id and a vector of finite components that are not all zero."""
    kind = df.schema[vec].dataType.elementType.simpleString()
    v = F.col(vec) if kind in ("float", "double") else F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_).isNotNull() & F.col(vec).isNotNull()).where(fine & F.exists(v, lambda x: x != 0)).select(F.col(id_).cast("long").alias("id"), v.alias("vec"))


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, by Euclidean distance in double precision.

    Every row is hashed in TABLES tables; a table's buckets are joined cell by cell with the queries that probe them, and
    distances are computed on the original vectors. A query for which fewer than ``k`` rows were found is
    compared with all rows. A cell with very many rows (near copies of
    one vector) is split by row into parts that its queries all visit; no bucket is capped.

    Rows and queries with a null id or vector, without a component that is not zero, or with a null, NaN or infinite
    component take no part. Vectors of different lengths are not compared. A query never finds rows of its own id;
    repeated rows count once; ties go to the smaller id. Empty tables give an empty result; other columns are ignored.
    """
    points, asked = usable(rows, id_, vec), usable(queries, id_, vec)
    if points.schema["vec"] != asked.schema["vec"]:
        points, asked = (d.withColumn("vec", F.col("vec").cast("array<double>")) for d in (points, asked))
    n = points.count()
    index = Index(n)
    kind = points.schema["vec"].dataType.elementType.simpleString()
    encoded = points.mapInArrow(index.encode, ENCODED.format(kind))
    full = encoded.select("dim", "tab", "cell").groupBy("dim", "tab", "cell").agg(F.count(F.lit(1)).alias("n"))
    limit = max(2 * CELL_ROWS, n * HOT_SHARE)
    hot = F.broadcast(staged(full.where(F.col("n") > limit).select("dim", "tab", "cell", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "hot-cells"))  # at most TABLES / HOT_SHARE rows
    parts = F.coalesce("parts", F.lit(1))
    at = ["dim", "tab", "cell"]
    held = encoded.join(hot, at, "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")

    def answers(asks: DataFrame, held: DataFrame) -> DataFrame:
        asks = asks.join(hot, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        met = held.withColumns({"asks": F.lit(False), "codes": F.lit(None).cast("array<long>")}).unionByName(asks.withColumns({"asks": F.lit(True), "code": F.lit(None).cast("long")}))
        met = met.repartition(*at, "part").sortWithinPartitions(*at, "part", "asks")
        return met.mapInArrow(search(k), FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    found = staged(answers(asked.mapInArrow(index.probe, PROBED.format(kind)), held), "neighbours")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = staged(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short-queries")
    if short.limit(1).count():
        cells = encoded.where("tab = 0").select(*at).distinct()
        everywhere = short.withColumn("dim", F.size("vec")).join(cells, "dim").withColumn("codes", F.lit(None).cast("array<long>")).select("dim", "tab", "cell", "codes", "id", "vec")
        found = found.unionByName(answers(everywhere, held.where("tab = 0"))).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
