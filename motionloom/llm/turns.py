"""Conversation turns: keys, positions in a conversation, digests in streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motionloom.session import staged


def digest(c: Column) -> Column:
    """128 bits of SHA-256, as bytes: equal digests count as equal contents."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def turn_key(role: Column, text: Column) -> Column:
    return digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def key_changes(key: pa.Array, last: list) -> np.ndarray:
    """Where a key begins in a sorted batch; ``last`` remembers the key across batches (nulls are a key of their own)."""
    values = pc.fill_null(key, 0).to_numpy(zero_copy_only=False)
    null = key.is_null().to_numpy(zero_copy_only=False)
    new = np.r_[True, (values[1:] != values[:-1]) | (null[1:] != null[:-1])]
    new[0] = not last or last[0] != (values[0], null[0])
    last[:] = [(values[-1], null[-1])]
    return new


def in_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` in partitions that follow each other in the order of ``key`` and ``order``: a large key is spread over several."""
    return df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)


def numbered(df: DataFrame, key: str, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``weight`` over the earlier rows of the same key (nulls first in ``order``). The rows are written.

    Rows are counted inside range partitions; a key that began in an earlier partition (at most one for each partition,
    so that table may be broadcast) gets what its earlier partitions hold.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, part = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = key_changes(batch.column(key), last)
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(w)
            at = ends - w
            began = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
            begin = np.where(began >= 0, at[np.maximum(began, 0)], -total)
            total = int(ends[-1] - begin[-1])
            yield pa.record_batch([*batch.columns, at - begin, np.full(len(w), part, np.int32)], names=[*batch.schema.names, out, "__part"])

    local = staged(in_order(df, key, order).mapInArrow(count, f"{types}, `{out}` long, __part int"), "numbered")
    per_part = local.groupBy(key, "__part").agg(F.sum(weight).alias("__n"))
    over = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = per_part.withColumn("__before", F.sum("__n").over(over)).where("__before IS NOT NULL").select(F.col(key).alias("__key"), F.col("__part").alias("__p"), "__before")
    joined = local.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop("__key", "__p", "__before", "__part")


def joined_digests(df: DataFrame, key: str, order: str, text: str, separator: str) -> DataFrame:
    """(key, sha256): of each key's texts in ``order`` with the separator between. The text streams by; no key is held whole."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, sha = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts, done, sums = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for k, s in zip(keys, texts, strict=True):
                if not last or last[0] != k:
                    if last:
                        done.append(now), sums.append(sha.hexdigest())
                    last, now, sha = [k], k, hashlib.sha256()
                else:
                    sha.update(separator.encode())
                sha.update(s.encode())
            yield pa.record_batch([pa.array(done, batch.schema.field(0).type), pa.array(sums, pa.string())], names=[key, "sha256"])
        if last:
            yield pa.record_batch([pa.array([now], batch.schema.field(0).type), pa.array([sha.hexdigest()], pa.string())], names=[key, "sha256"])

    rows = df.select(key, text, order).repartition(key).sortWithinPartitions(key, order)
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, sha256 string")
