"""Substring dedup: relative Lempel-Ziv factors of at least 50 words, copied from documents with smaller ids.

The texts' stretches around anchors of several contexts (see ``anchors``) are the reference, dealt so that equal windows
meet; anchors are worked on one after the other, many to a block indexed by a suffix array over its words. Every stretch
is factored greedily against the blocks of its anchor: at each place the longest match in an earlier document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .suffix import common_prefixes, spans, suffix_array
from .tokens import Sums, shards

WINDOW, K = 50, 12
#: Bytes of text of one reference block.
BLOCK = 8 << 20


def longest_earlier(sa: np.ndarray, lcp: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """By place: the longest common prefix with a suffix of a document with a smaller id; 0 if under ``least``.

    On either side in suffix order the nearest suffix of a smaller document has it; pointers to the
    nearest double their reach in each round.
    """
    out = np.zeros(len(sa), np.int64)
    for way in (1, -1):
        d = doc[sa][::way]
        n = len(d)
        near = np.arange(-1, n - 1)
        have = (lcp if way == 1 else np.concatenate((lcp[1:], [0]))[::-1]).astype(np.int64)
        have[(near < 0) | (have < least)] = 0
        open_ = np.flatnonzero((near >= 0) & (have > 0))
        open_ = open_[d[near[open_]] >= d[open_]]
        while len(open_):
            p = near[open_]
            have[open_] = np.minimum(have[open_], have[p])
            have[open_[have[open_] < least]] = 0
            near[open_] = near[p]
            open_ = open_[(near[open_] >= 0) & (have[open_] > 0)]
            open_ = open_[d[near[open_]] >= d[open_]]
        have[near < 0] = 0
        have = have[::way]
        out[sa] = np.maximum(out[sa], have)
    return out


def factors(match: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Greedy parse of every stretch, all abreast: marks where factors start (a word without a sufficient match is its own)."""
    cut = np.zeros(len(match) + 1, bool)
    at = begin[begin < end].copy()
    stop = end[begin < end]
    while len(at):
        cut[at] = True
        at = at + np.maximum(match[at], 1)
        on = at < stop
        at, stop = at[on], stop[on]
    cut[end] = True
    return cut


def copied(match: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows that an earlier document has: inside a factor of ``window`` words or more, or across a
    factor's boundary, where the match at the start itself is looked at (a greedy factor may end inside a window)."""
    cut = factors(match, begin, end)
    places = np.arange(len(match))
    boundary = np.where(cut[1:], places + 1, len(match) + window)
    boundary = np.minimum.accumulate(boundary[::-1])[::-1]
    start = np.maximum.accumulate(np.where(cut[:-1], places, 0))
    inside = (boundary - places >= window) & (match[start] >= window)
    across = (boundary - places < window) & (match >= window)
    return np.flatnonzero(inside | across)


def _match(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """The longest earlier match at each place of the stretches, cut at their ends and at two windows; 0 if under a window."""
    words = np.unique(codes, return_inverse=True)[1] + 1
    owner = np.searchsorted(begin, np.arange(len(codes)), side="right") - 1
    words[end[end < len(words)]] = 0  # a separator after each stretch
    sa = suffix_array(words)
    lcp = common_prefixes(words, sa, begin, end, 2 * window)
    room = end[owner] - np.arange(len(codes))
    return np.minimum(longest_earlier(sa, lcp, doc[owner], window), np.maximum(room, 0))


def whole_anchors(batches, size: int):
    """BODY rows sorted by anchor as lists of (rows, bodies) that hold all rows of their anchors: one piece of about
    ``size`` bytes for many anchors, and several for an anchor that reaches beyond a piece."""
    group = []
    for rows, bodies in shards(batches, size, "body"):
        gram = rows["gram"].to_numpy()
        if group:
            n = int(np.searchsorted(gram, group[0][0]["gram"][0].as_py(), side="right"))
            if n:
                group.append((rows.slice(0, n), bodies[:n]))
            if n == len(gram):
                continue
            yield group
            rows, bodies, gram = rows.slice(n), bodies[n:], gram[n:]
        last = int(np.searchsorted(gram, gram[-1]))  # the last anchor may go on in the next piece
        if last:
            yield [(rows.slice(0, last), bodies[:last])]
        group = [(rows.slice(last), bodies[last:])]
    if group:
        yield group


def _shared(pieces: list[tuple[pa.Table, list[bytes]]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """By body: has it a window (by hash) that stands in several documents, and is it the smallest document of such a window?"""
    hashes, bodies, docs, upto = [], [], [], 0
    for rows, texts in pieces:
        codes, begin, end, *_ = anchors.codes_of(texts, "word")
        n = np.maximum(end - begin - window + 1, 0)
        at = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        owner = np.repeat(np.arange(len(texts)), n)
        hashes.append(Sums(codes).of(at, at + window))
        bodies.append(owner + upto)
        docs.append(rows["doc"].to_numpy()[owner])
        upto += len(texts)
    hashes, bodies, docs = (np.concatenate(x) for x in (hashes, bodies, docs))
    order = np.lexsort((docs, hashes))
    hashes, bodies, docs = hashes[order], bodies[order], docs[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    several = docs[np.append(first[1:], len(docs)) - 1] != docs[first] if len(docs) else np.zeros(0, bool)
    kept, leads = np.zeros(upto, bool), np.zeros(upto, bool)
    kept[bodies[several[group]]] = True
    leads[bodies[first[several]]] = True
    return kept, leads


def _deal(pieces: list[tuple[pa.Table, list[bytes]]], chosen: np.ndarray, size: int):
    """The chosen bodies as blocks of about ``size`` bytes, by document: rows, codes with a place for a separator after each body, their [begin, end)."""
    rows = pa.concat_tables([r for r, _ in pieces])
    bodies = [x for _, texts in pieces for x in texts]
    chosen = np.flatnonzero(chosen)
    chosen = chosen[np.argsort(rows["doc"].to_numpy()[chosen], kind="stable")]  # then equal suffixes, sorted by place, have their first document first
    part = np.cumsum([len(bodies[i]) for i in chosen.tolist()]) // size
    for at in np.split(chosen, np.flatnonzero(np.diff(part)) + 1) if len(chosen) else []:
        found, begin, end, *_ = anchors.codes_of([bodies[i] for i in at.tolist()], "word")
        shift = np.arange(len(at))
        codes = np.zeros(len(found) + len(at), np.uint64)
        codes[np.arange(len(found)) + np.repeat(shift, end - begin)] = found
        yield rows.take(pa.array(at)), codes, begin + shift, end + shift


def _resolve(window: int, size: int):
    """BODY rows of whole anchors, sorted by anchor, to the spans of windows that a smaller document has.

    Equal windows share an anchor, so pieces without a common anchor are not compared. Bodies without a window that
    stands in several documents have no factor. The rest is factored against itself where it is one block, else block
    by block against the bodies that hold a window's smallest document: any other would only match the same again.
    """

    def run(batches):
        for pieces in whole_anchors(batches, size):
            kept, leads = _shared(pieces, window)
            blocks = list(_deal(pieces, kept, size))
            references = list(_deal(pieces, leads, size)) if len(blocks) > 1 else []
            for rows, codes, begin, end in blocks:
                doc = rows["doc"].to_numpy()
                found = copied(_match(codes, begin, end, doc, window), begin, end, window) if not references else np.zeros(0, np.int64)
                for rows2, codes2, begin2, end2 in references:
                    n = len(codes2)
                    both = _match(np.concatenate((codes2, codes)), np.concatenate((begin2, begin + n)), np.concatenate((end2, end + n)), np.concatenate((rows2["doc"].to_numpy(), doc)), window)
                    found = np.union1d(found, copied(both[n:], begin, end, window))
                lane = np.searchsorted(begin, found, side="right") - 1
                places = rows["places"].combine_chunks()
                count = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(count) - count
                n = count[lane]
                which = np.repeat(first[lane], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shift = places.flatten().to_numpy()[which] - np.repeat(rows["pos"].to_numpy()[lane], n)
                start = np.repeat(found - begin[lane] + rows["low"].to_numpy()[lane], n) + shift
                yield from spans(np.repeat(rows["row"].to_numpy()[lane], n), start, window)

    return run


def _remove(batches):
    for rows, texts in shards(batches):
        out = []
        for text, found in zip(texts, rows["spans"].to_pylist(), strict=True):
            words = text.split()
            n, removed = len(words), 0
            if found:
                low, high = anchors.merged(np.array([s["low"] for s in found]), np.array([s["high"] for s in found]))
                removed = int((high - low).sum())
                edge = [0, *np.stack((low, high), 1).ravel().tolist(), n]
                words = [w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in words[a:b]]
            out.append((n, removed, b" ".join(words)))
        n, removed, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_copies(docs: DataFrame, window: int = WINDOW, k: int = K, size: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by a space) of every document row.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id
    (null before all). Repeats inside one document stay. Null and empty texts have no words; repeated rows with one
    doc_id are the same document and are answered alike.
    """
    texts, found = anchors.repeated_spans(docs, "word", window, k, False, _resolve(window, size), ordered=True)
    out = texts.join(found, "row", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary")
