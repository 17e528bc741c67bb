"""Numpy helpers of the operators that work on bytes or words inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of text that are worked on together in a task: the memory of a task follows this and its longest text.
SHARD_BYTES = 2 << 20
#: Fixed random multipliers: equal on all executors and in all runs.
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD_BYTES, column: str = "text") -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows of consecutive batches with their texts as UTF-8 bytes (null: empty), about ``size`` bytes at a time."""
    rows, texts, held = [], [], 0
    for batch in batches:
        at, values = 0, [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
        for i, v in enumerate(values):
            held += len(v)
            if held >= size:
                rows.append(batch.slice(at, i + 1 - at))
                texts += values[at : i + 1]
                yield pa.Table.from_batches(rows), texts
                rows, texts, held, at = [], [], 0, i + 1
        if at < len(values):
            rows.append(batch.slice(at))
            texts += values[at:]
    if texts:
        yield pa.Table.from_batches(rows), texts


def shard_ids() -> Iterator[int]:
    """Numbers of a task's shards, in order: no other shard of the stage has them, whatever its rows; a repeated task gives the same."""
    task = TaskContext.get()
    return count((task.partitionId() if task else 0) << 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits (in place on a copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sums:
    """Hashes of any stretch of a sequence of codes in constant time (a polynomial modulo 2**64, scrambled)."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        if len(Sums._up) < n:
            Sums._up, Sums._down = (np.concatenate(([np.uint64(1)], np.full(n + n // 4, s, np.uint64))).cumprod(dtype=np.uint64) for s in (STEP, BACK))
        self.total = np.zeros(n, np.uint64)
        np.cumsum(codes * Sums._up[: n - 1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * Sums._down[start])

    def grams(self, k: int) -> np.ndarray:
        """Of all stretches of length k, in order."""
        return mix((self.total[k:] - self.total[:-k]) * Sums._down[: len(self.total) - k])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array with a space after each; the start and end of each."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(length + 1) - 1
    return data, end - length, end


def find_words(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before its end."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(space)]))
    start, stop = edge[::2], edge[1::2]
    return start, stop, np.searchsorted(start, end)


def word_codes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word's bytes: every eight of them are scrambled with a key of their place, then added up.

    Places have unrelated keys, so no arrangement of the same letters cancels out, as it does in a polynomial.
    """
    n = (stop - start + 7) >> 3
    head = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(head, n)
    at = np.repeat(start, n) + 8 * place
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))[at]
    eight &= _FIRST[np.minimum(np.repeat(stop, n) - at, 8)]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(eight ^ mix((place + 1).astype(np.uint64))), dtype=np.uint64)))
    return mix((upto[head + n] - upto[head]) ^ mix((stop - start).astype(np.uint64)))
