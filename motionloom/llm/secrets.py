"""Secret scans: fixed patterns, and a battery of randomness tests with a false-discovery bound.

A run of 20 or more characters of an encoding's alphabet that has not the shape of a word (letters of one case, or a capital first) is tested for being uniformly random: chi-squared
over the alphabet, runs about the median, lag-one serial correlation, combined by Fisher. How random natural words look is
counted over the whole corpus, by encoding and length. Words seldom reach the lengths of keys, so each natural word is also
counted run on with the natural words after it, as far as each longer bin begins; a bin that still has too few takes in the
next shorter ones, which look more random, not less. A run's p-value is the share of what its bin counts that looks as
random, and Benjamini-Hochberg bounds the share of false finds.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .tokens import joined, shards

#: Fixed values. Kind, pattern, the group whose length counts (0: the whole match) and its least length.
PATTERNS = [
    ("assign", re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE), 2, 6),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(rb"[0-9a-f]{24,}"), 0, 24),
]
KINDS = ["assign", "access", "hex", "random"]
_HINTS = (b"passw", b"secret", b"token", b"api")
#: Least length of a tested run, of a natural word counted, the lengths that begin a bin, and the false-discovery rate.
SHORTEST, LENGTHS, RATE = 20, np.array([12, 16, 20, 24, 32, 48]), 0.01
#: Scores (log10 of the combined p-value) go to bins of a tenth from -30 to 0.
SCORES = 301


def _table(chars: str) -> np.ndarray:
    t = np.full(256, -1, np.int64)
    for i, c in enumerate(chars):
        t[ord(c)] = i
    return t


_A, _a, _0 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_HEX = _table(_0 + "abcdef")
_HEX[[ord(c) for c in "ABCDEF"]] = np.arange(10, 16)
_B32 = _table(_A + "234567")
_B64 = _table(_A + _a + _0 + "+/")
_B64[[ord("-"), ord("_")]] = 62, 63
#: The encodings inferred, narrowest first: the symbols' numbers and how many there are.
ENCODINGS = [(_HEX, 16), (_B32, 32), (_B64, 64)]
_RUN = _B64 >= 0
_LOWER, _UPPER = (np.isin(np.arange(256), [ord(c) for c in s]) for s in (_a, _A))


def normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.fromiter((math.erfc(x) for x in (z / math.sqrt(2)).tolist()), float, len(z))


def randomness(values: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """log10 of Fisher's combined p-value of each run of symbols (0 .. size-1) being uniform and independent."""
    n = length.astype(float)
    owner = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    v = values[np.repeat(begin, length) + place]
    counts = np.bincount(owner * size + v, minlength=len(length) * size).reshape(-1, size)
    chi = (counts.astype(float) ** 2).sum(1) * size / n - n
    k = size - 1
    p1 = normal_tail((np.cbrt(chi / k) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))  # Wilson and Hilferty
    high = v >= size / 2
    change = np.zeros(len(v), bool)
    change[1:] = (high[1:] != high[:-1]) & (place[1:] > 0)
    edges = 1 + np.bincount(owner[change], minlength=len(n))
    p2 = 2 * normal_tail(np.abs(edges - 1 - (n - 1) / 2) / np.sqrt((n - 1) / 4))
    x = (v - (size - 1) / 2) / math.sqrt((size * size - 1) / 12)
    product = np.zeros(len(v))
    product[1:] = np.where(place[1:] > 0, x[1:] * x[:-1], 0)
    p3 = 2 * normal_tail(np.abs(np.bincount(owner, product, minlength=len(n))) / np.sqrt(n - 1))
    half = -np.log(np.clip(np.stack((p1, p2, p3)), 1e-300, 1)).sum(0)
    return np.maximum((-half + np.log1p(half + half * half / 2)) / math.log(10), -30)


def cells(encoding: int, length: np.ndarray, score: np.ndarray) -> np.ndarray:
    """A number of each encoding, length bin and score bin: at most 3 * 6 * 301."""
    bin_ = np.searchsorted(LENGTHS, length, side="right") - 1
    return ((encoding * len(LENGTHS) + bin_) * SCORES + np.round((score + 30) * 10).astype(np.int64)).astype(np.int32)


def tested(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The cell of each run: tested in the narrowest encoding that has all its symbols."""
    out, open_ = np.zeros(len(begin), np.int32), np.ones(len(begin), bool)
    for e, (table, size) in enumerate(ENCODINGS):
        bad = np.concatenate(([0], np.cumsum(table[data] < 0)))
        mine = open_ & (bad[begin + length] == bad[begin])
        if mine.any():
            out[mine] = cells(e, length[mine], randomness(table[data], begin[mine], length[mine], size))
        open_ &= ~mine
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in bytes."""
    low, out = text.lower(), []
    for k, (_, pattern, group, least) in enumerate(PATTERNS):
        if k == 0 and not any(h in low for h in _HINTS) or k == 1 and b"AKIA" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def run_on(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural words of a counted length continued by the natural words of their text behind them, cut where each bin that the
    word does not reach begins: the words' letters without what is between them, and the start and length of each stretch."""
    at = np.cumsum(size) - size
    letters = data[np.repeat(begin - at, size) + np.arange(size.sum())]
    upto = np.append(at, size.sum())[np.searchsorted(owner, owner, side="right")]  # where the letters of the word's text end
    long_ = np.flatnonzero(size >= LENGTHS[0])
    out = [(at[w], np.full(len(w), n)) for n in LENGTHS[LENGTHS >= SHORTEST] for w in [long_[(size[long_] < n) & (at[long_] + n <= upto[long_])]]]
    return letters, *(np.concatenate(x) for x in zip(*out, strict=True))


def covered(start: int, end: int, spans: list[dict]) -> bool:
    """Whether spans, given by start, hold all of [start, end) together."""
    for x in spans:
        if x["start"] <= start:
            start = max(start, x["end"])
    return start >= end


SCHEMA = "doc_id {}, base array<struct<start:int,kind:int,end:int>>, maybe array<struct<start:int,kind:int,end:int,cell:int>>, natural array<int>, times array<long>"


def _scan(batches):
    for rows, texts in shards(batches):
        data, start, end = joined(texts)
        point = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
        run = _RUN[data]
        edge = np.flatnonzero(np.concatenate(([run[:1].any()], run[1:] != run[:-1])))
        if len(edge) % 2:
            edge = np.append(edge, len(data))
        a, b = edge[::2], edge[1::2]
        total = [np.concatenate(([0], np.cumsum(t[data]))) for t in (_LOWER, _UPPER)]
        lower, upper = (t[b] - t[a] for t in total)
        size = b - a
        shape = (lower == size) | (upper == size) | ((lower == size - 1) & _UPPER[data[np.minimum(a, max(len(data) - 1, 0))]])
        word = (size >= LENGTHS[0]) & shape
        long_ = (size >= SHORTEST) & ~shape
        more = run_on(data, a[shape], size[shape], np.searchsorted(end, a[shape], side="right"))
        natural, times = np.unique(np.concatenate((tested(data, a[word], size[word]), tested(*more))), return_counts=True)
        a, size = a[long_], size[long_]
        cell, owner = tested(data, a, size), np.searchsorted(end, a, side="right")
        hexes = _HEX[data] >= 0
        far = np.flatnonzero(np.concatenate(([True], hexes[1:] != hexes[:-1], [True])))
        has_hex = np.zeros(len(texts), bool)
        at = far[:-1][(np.diff(far) >= 24) & hexes[far[:-1]]] if len(data) else far[:0]
        has_hex[np.searchsorted(end, at, side="right")] = True
        base, maybe = [[] for _ in texts], [[] for _ in texts]
        for i, text in enumerate(texts):
            low = text.lower()
            if has_hex[i] or b"AKIA" in text or any(h in low for h in _HINTS):
                first = int(point[start[i] - 1]) if start[i] else 0
                to = lambda x, i=i, first=first: (int(point[start[i] + x - 1]) if start[i] + x else 0) - first
                base[i] = [{"start": to(s), "kind": k, "end": to(e)} for s, k, e in base_spans(text)]
        for i, s, n, c in zip(owner.tolist(), a.tolist(), size.tolist(), cell.tolist(), strict=True):
            first = int(point[start[i] - 1]) if start[i] else 0
            s, e = (int(point[s - 1]) if s else 0) - first, int(point[s + n - 1]) - first
            if not covered(s, e, base[i]):
                maybe[i].append({"start": s, "kind": 3, "end": e, "cell": c})
        none = [[]] * (len(texts) - 1)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        more = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("cell", pa.int32())]))
        cols = [rows["doc_id"].combine_chunks(), pa.array(base, spans), pa.array(maybe, more), pa.array([natural.tolist(), *none], pa.list_(pa.int32())), pa.array([times.tolist(), *none], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "base", "maybe", "natural", "times"])


def accepted(natural: dict[int, int], maybe: dict[int, int], rate: float = RATE) -> list[int]:
    """Cells of runs to report, from the counts of natural words and of tested runs by cell (a bounded table)."""
    null, seen = (np.zeros((len(ENCODINGS), len(LENGTHS), SCORES)) for _ in range(2))
    for counts, to in ((natural, null), (maybe, seen)):
        for c, n in counts.items():
            to.reshape(-1)[c] += n
    all_words = null.sum(0)  # natural words are no encoding's: each encoding's null is that of all
    p = np.ones_like(seen)
    for b in range(len(LENGTHS)):
        words, j = all_words[b].copy(), b
        while j > 0 and 1 + words.sum() < 1 / rate:  # too few to reach the rate: with the next shorter ones
            j -= 1
            words += all_words[j]
        tail = np.cumsum(words[::-1])[::-1]
        p[:, b] = (1 + tail) / (1 + tail[0])
    order = np.argsort(p, axis=None)
    upto = np.cumsum(seen.reshape(-1)[order])
    good = np.flatnonzero((p.reshape(-1)[order] <= rate * upto / max(upto[-1], 1)) & (seen.reshape(-1)[order] > 0))
    limit = p.reshape(-1)[order][good[-1]] if len(good) else -1.0
    return np.flatnonzero((p.reshape(-1) <= limit) & (seen.reshape(-1) > 0)).tolist()


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and found of every document row: arrays of (start, kind, end) in code points, end exclusive.

    ``base`` has the fixed patterns' matches, leftmost and not overlapping per kind; ``found`` those of the random runs
    that the bound admits and that they do not cover: such a run is reported whole, with what a pattern matched of it. Without natural words in the corpus no run is reported. A null
    or empty text has none; rows stay as many as they are.
    """
    scanned = staged(docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())), "secrets")
    natural = scanned.select(F.explode(F.arrays_zip("natural", "times")).alias("x")).groupBy("x.natural").agg(F.sum("x.times").alias("n"))
    maybe = scanned.select(F.explode("maybe.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    cells = accepted({r[0]: r[1] for r in natural.collect()}, {r[0]: r[1] for r in maybe.collect()}, rate)  # at most 5,418 cells each
    found = F.filter("maybe", lambda x: x["cell"].isin(cells)) if cells else F.slice("maybe", 1, 0)
    return scanned.select("doc_id", "base", F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
