"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier in the corpus.

Shards are stretches of text around anchors of several contexts (see ``anchors``), dealt so that equal windows share a
partition. Each shard gets a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's walk; classes of
equal windows follow. The classes of a partition's shards are merged by binary search in their sorted order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .tokens import shards

WINDOW, K = 100, 32
#: Bytes of one suffix array.
SHARD = 4 << 20


def refine(sa: np.ndarray, rank: np.ndarray, h: int) -> np.ndarray:
    """``sa``, sorted by ``h`` symbols with the groups' first places in ``rank``, sorted to the end (Kasai's walk needs it).

    Larsson-Sadakane: only groups of several suffixes are sorted again, by the rank ``h`` symbols on, with h doubling.
    """
    n = len(sa)
    where = np.arange(n)
    while len(where):
        r = rank[sa[where]]
        where = where[~(np.concatenate((r[1:] != r[:-1], [True])) & np.concatenate(([True], r[1:] != r[:-1])))]
        if not len(where):
            break
        at = sa[where]
        own, then = rank[at], rank[np.minimum(at + h, n)] + 1
        order = np.argsort(own * (n + 2) + then, kind="stable")
        at, own, then = at[order], own[order], then[order]
        sa[where] = at
        head = np.concatenate(([True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])))
        rank[at] = where[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        h *= 2
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence in order; bytes go eight at once in the first round."""
    n, h, key = len(text), 1, text
    if text.dtype == np.uint8:
        wide, h = np.concatenate((text, np.zeros(8, np.uint8))), 8
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = key << np.uint64(8) | wide[i : i + n]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.concatenate(([True], key[1:] != key[:-1]))[:n]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return refine(sa, rank, h)


def common_prefixes(text: np.ndarray, sa: np.ndarray, begin: np.ndarray, end: np.ndarray, cap: int) -> np.ndarray:
    """Per place in ``sa`` order: bytes in common with the suffix before it, up to ``cap``.

    Kasai's walk in text order (the prefix shrinks by at most one from a place to the next), one lane per
    stretch [begin, end), all lanes abreast.
    """
    n = len(text)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    wide = np.concatenate((text.astype(np.int64), [-1]))
    out = np.zeros(n, np.int32)
    have = np.zeros(len(begin), np.int64)
    for step in range(int((end - begin).max(initial=0))):
        lane = np.flatnonzero(begin + step < end)
        at = begin[lane] + step
        other, h = before[at], np.maximum(have[lane] - 1, 0)
        go = np.flatnonzero((other >= 0) & (h < cap))
        while len(go):
            a, b = at[go] + h[go], other[go] + h[go]
            same = (a < n) & (b < n)
            same &= wide[np.minimum(a, n)] == wide[np.minimum(b, n)]
            go = go[same]
            h[go] += 1
            go = go[h[go] < cap]
        h[other < 0] = 0
        have[lane] = h
        out[at] = h
    return out[sa]


def classes(text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside the stretches, in suffix order, and the index of each one's class of equal windows."""
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, begin, end, window)
    owner = np.searchsorted(begin, sa, side="right") - 1
    whole = sa + window <= end[owner]
    label = np.cumsum(lcp < window)  # a chain of long common prefixes is a class
    return sa[whole], np.unique(label[whole], return_inverse=True)[1]


def _resolve(window: int, size: int):
    """BODY rows of whole anchors to the spans of windows that start earlier elsewhere."""

    def run(batches):
        done = []  # per shard: rows, window starts (lane, offset), class, and per class its window's bytes and first start
        for rows, bodies in shards(batches, size, "body"):
            text = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
            length = np.fromiter(map(len, bodies), np.int64, len(bodies))
            end = np.cumsum(length + 1) - 1
            begin = end - length
            at, label = classes(text, begin, end, window)
            lane = np.searchsorted(begin, at, side="right") - 1
            low, doc = rows["low"].to_numpy()[lane], rows["doc"].to_numpy()[lane]
            start = at - begin[lane] + low
            order = np.lexsort((start, doc, label))
            first = order[np.concatenate(([True], label[order][1:] != label[order][:-1]))[: len(order)]] if len(order) else order
            keys = np.lib.stride_tricks.sliding_window_view(text, window)[at[first]] if len(first) else np.zeros((0, window), np.uint8)
            keys = np.ascontiguousarray(keys).view(f"S{window}").ravel()  # in suffix order: sorted
            done.append([rows["row"].to_numpy()[lane], doc, start, label, keys, doc[first], start[first]])
        for i, (row, doc, start, label, keys, first_doc, first_start) in enumerate(done):
            best_doc, best_start = first_doc.copy(), first_start.copy()
            for j, other in enumerate(done):  # the other shards' classes, by binary search
                if j != i and len(other[4]) and len(keys):
                    at = np.minimum(np.searchsorted(other[4], keys), len(other[4]) - 1)
                    sooner = (other[4][at] == keys) & ((other[5][at] < best_doc) | ((other[5][at] == best_doc) & (other[6][at] < best_start)))
                    best_doc[sooner], best_start[sooner] = other[5][at][sooner], other[6][at][sooner]
            again = (best_doc[label] < doc) | ((best_doc[label] == doc) & (best_start[label] < start))
            row, start = row[again], start[again]
            yield from spans(row, start, window)

    return run


def spans(row: np.ndarray, start: np.ndarray, window: int):
    """SPAN rows of window starts: overlapping and touching windows of a row are one."""
    if not len(row):
        return
    order = np.lexsort((start, row))
    row, start = row[order], start[order].astype(np.int64)
    head = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)))
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(row)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(start[at].astype(np.int32)), pa.array((start[last] + window).astype(np.int32))], ["row", "low", "high"])


def _remove(batches):
    for rows, texts in shards(batches):
        out = []
        for text, found in zip(texts, rows["spans"].to_pylist(), strict=True):
            kept, removed, count = text, 0, 0
            if found:
                low, high = anchors.merged(np.array([s["low"] for s in found]), np.array([s["high"] for s in found]))
                removed, count = int((high - low).sum()), len(low)
                edge = [0, *np.stack((low, high), 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
            out.append((len(text), removed, count, kept))
        n, removed, count, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, size: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document row.

    A byte goes if it lies in a ``window``-byte string that also starts earlier: in a smaller doc_id (null before
    all), or earlier in the same document. Null texts are empty; texts under ``window`` bytes stay; of repeated rows
    with one doc_id and text, all are answered alike, as one document.
    """
    texts, found = anchors.repeated_spans(docs, "byte", window, k, True, _resolve(window, size))
    out = texts.join(found, "row", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")

