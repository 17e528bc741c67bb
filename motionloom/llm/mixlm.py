"""LM scoring by online logistic context mixing.

A text is the sequence of its lower-cased words and an end. Words of a bounded dictionary (and the end, and an escape) have Huffman
codes, other words are escaped and spelled by bytes with Huffman codes of their own; so a text is a sequence of yes-no decisions.
For each decision four predictors look up counts by hashed contexts (at word level: none, the word before, the two before, the
one before that; in spelling: the last 1, 2 and 4 bytes, and all of the word so far). Their log-odds are combined by weights that a gate selects (how
often the longer contexts were seen), learned online, and the result is refined by a table of what came true.

Counts, weights and table come from all training texts, each by one pass with sums of fixed-size tables; a decision's own
count is left out while weights are learned. Nothing depends on how texts are dealt but the weights, to rounding and averaging.
"""

from __future__ import annotations

import heapq
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .anchors import keyed
from .tokens import BYTE_CODE, LOWER, Sums, find_words, joined, mix, shard_ids, shards, word_codes

#: The model's size, whatever the corpus: dictionary words, slots of each table (a power of two), bins of the refining table.
WORDS, SLOT_BITS, BINS = 4096, 18, 33
SLOTS = 1 << SLOT_BITS
TABLES, GATES = 4, 16
#: Bytes of text at a time; decisions at a time (few enough for a core's cache), and when slots are counted.
SHARD, CHUNK, COUNTED, LEXICON_ROWS = 2 << 20, 1 << 15, 1 << 17, 50_000
#: Costs of spelled words that a worker remembers (of the last model), and how many.
_SPELLED: dict[str, tuple[np.ndarray, np.ndarray]] = {}
REMEMBERED = 1_500_000
_START = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Tokens:
    """Words of a shard of texts: codes, places, and which texts train."""

    def __init__(self, rows: pa.Table, texts: list[bytes]):
        data, _, end = joined(texts)
        self.data = LOWER[data]
        self.start, self.stop, upto = find_words(self.data, end)
        self.code = word_codes(self.data, self.start, self.stop)
        self.first = np.concatenate(([0], upto[:-1])).astype(np.int64)
        self.count = upto - self.first
        self.held = np.fromiter(map(held_out, rows["doc_id"].to_pylist()), bool, len(texts))
        self.owner = np.repeat(np.arange(len(texts)), self.count)

    def spelled(self, word: np.ndarray):
        """A function giving the words number a to b of ``word``, each with a space after it."""
        length = self.stop[word] - self.start[word] + 1  # every word has white space or the texts' separator after it
        end = np.concatenate(([0], np.cumsum(length)))
        data = self.data[np.repeat(self.start[word], length) + _within(length)]
        data[end[1:] - 1] = 32
        return lambda a, b: data[end[a] : end[b]].tobytes()


# --- counts of words, and the base score -------------------------------------------------------------------------------------

ASKED = "bucket int, shard long, codes binary, owners binary, times binary, meta binary, letters binary, words binary"
ANSWERED = "shard long, kind int, base binary, known binary, meta binary, codes array<long>, counts array<long>, vocabulary long, tokens long"


def _ask(buckets: int):
    """Each shard's (word, text, times) by hash bucket, and its distinct words in the same order; with bucket 0 goes how often its training words have each byte, and their number."""

    def run(batches):
        for shard, (rows, texts) in zip(shard_ids(), shards(batches, SHARD)):  # noqa: B905
            t = Tokens(rows, texts)
            order = np.lexsort((t.owner, t.code))
            code, owner = t.code[order], t.owner[order]
            at = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))[: len(code)])
            place = order[at]
            times = np.diff(np.append(at, len(code))).astype(np.uint32)
            code, owner = code[at], owner[at].astype(np.uint32)
            bucket = (code >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            code, owner, times, place = code[order], owner[order], times[order], place[order]
            first = np.concatenate(([True], code[1:] != code[:-1]))[: len(code)]
            spelled, upto = t.spelled(place[first]), np.concatenate(([0], np.cumsum(first)))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            row = rows["row"].to_numpy()
            meta = np.stack((row, t.held.astype(np.int64), t.count.astype(np.int64))).tobytes()
            n, train = range(buckets), ~t.held[t.owner]
            length = (t.stop - t.start)[train]
            letters = np.bincount(t.data[np.repeat(t.start[train], length) + _within(length)], minlength=257)
            letters[256] = train.sum()
            letters = letters.astype(np.int64).tobytes()
            cols = [pa.array(list(n), pa.int32()), pa.array([shard] * buckets), *(pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in n], pa.binary()) for x in (code, owner, times)), pa.array([meta] * buckets, pa.binary()), pa.array([b"" if b else letters for b in n], pa.binary()), pa.array([spelled(upto[cut[b]], upto[cut[b + 1]]) for b in n], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "shard", "codes", "owners", "times", "meta", "letters", "words"])

    return run


def _answer(batches):
    """Within one partition: training counts of its words; each text's share of the base score, the words, and the most frequent."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    metas = [np.frombuffer(x, np.int64).reshape(3, -1) for x in t["meta"].to_pylist()]
    codes, owners, times = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("codes", np.uint64), ("owners", np.uint32), ("times", np.uint32)))
    size = np.array([len(x) // 8 for x in t["codes"].to_pylist()])
    end = np.cumsum(size)
    train = np.concatenate([m[1][owners[e - s : e]] == 0 for m, e, s in zip(metas, end, size, strict=True)]) if len(codes) else np.zeros(0, bool)
    kinds, back = np.unique(codes, return_inverse=True)
    c = np.bincount(back, times * train, minlength=len(kinds))
    log = np.log10(c + 0.1)
    names = ["shard", "kind", "base", "known", "meta", "codes", "counts", "vocabulary", "tokens"]
    done = np.zeros(0, np.int64)
    for i, (shard, meta, b) in enumerate(zip(t["shard"].to_pylist(), metas, t["bucket"].to_pylist(), strict=True)):
        part = slice(end[i] - size[i], end[i])
        of, n = owners[part], meta.shape[1]
        base = np.bincount(of, times[part] * log[back[part]], minlength=n)
        known = np.bincount(of, times[part] * (c[back[part]] > 0), minlength=n).astype(np.int32)
        cols = [[shard], [0], [base.tobytes()], [known.tobytes()], [meta.tobytes() if b == 0 else b""], [[]], [[]], [0], [0]]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, _ANSWER_TYPES, strict=True)], names)
    top = np.lexsort((kinds, -c))[:WORDS]
    top = top[c[top] > 0]
    first = np.concatenate([np.concatenate(([True], x[1:] != x[:-1]))[: len(x)] for x in (codes[e - s : e] for e, s in zip(end, size, strict=True))]) if len(codes) else np.zeros(0, bool)
    spell = b"".join(t["words"].to_pylist()).split()
    new = np.unique(codes[first], return_index=True)[1]  # an occurrence of each distinct word, in the order of kinds
    for a in range(0, len(kinds), LEXICON_ROWS):
        part = slice(a, a + LEXICON_ROWS)
        cols = [[0], [3], [b" ".join([spell[i] for i in new[part].tolist()])], [c[part].astype(np.uint32).tobytes()], [b""], [[]], [[]], [0], [0]]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, _ANSWER_TYPES, strict=True)], names)
    letters = sum((np.frombuffer(x, np.int64) for x in t["letters"].to_pylist() if x), np.zeros(257, np.int64))
    cols = [[0], [2], [b""], [b""], [b""], [list(range(257))], [letters.tolist()], [0], [0]]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, _ANSWER_TYPES, strict=True)], names)
    cols = [[0], [1], [b""], [b""], [b""], [kinds[top].view(np.int64).tolist()], [c[top].astype(np.int64).tolist()], [int((c > 0).sum())], [int(c.sum())]]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, _ANSWER_TYPES, strict=True)], names)


_ANSWER_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]


def _sum_up(batches):
    """Whole shards again: each text's row, whether it is held out, its words, known words and sum of log10(c + 0.1)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    parts: dict[int, list] = {}
    for shard, base, known, meta in zip(*(t[c].to_pylist() for c in ("shard", "base", "known", "meta")), strict=True):
        parts.setdefault(shard, []).append((np.frombuffer(base, float), np.frombuffer(known, np.int32), meta))
    for parts_ in parts.values():
        row, out, n = np.frombuffer(next(m for _, _, m in parts_ if m), np.int64).reshape(3, -1)
        ordered = sorted(parts_, key=lambda x: x[0].tobytes())  # sums don't depend on arrival
        base, known = sum(x[0] for x in ordered), sum(x[1].astype(np.int64) for x in ordered)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(out == 1), pa.array(n), pa.array(known), pa.array(base)], ["row", "held_out", "n_words", "known", "base"])


# --- the model ------------------------------------------------------------------------------------------------------------------


class Code:
    """Huffman codes of symbols 0 .. n-1, flat: the decisions of symbol s are ``node`` and ``bit`` from ``offset[s]`` on, ``length[s]`` of them."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children, at = {}, n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[at] = (a[1], b[1])
            heapq.heappush(heap, (a[0] + b[0], at))
            at += 1
        paths: list = [()] * n
        stack = [(at - 1, ())]
        while stack:
            x, path = stack.pop()
            if x < n:
                paths[x] = path
            else:
                stack += [(children[x][k], (*path, (x - n, k))) for k in (0, 1)]
        self.length = np.array([len(p) for p in paths])
        self.offset = np.cumsum(self.length) - self.length
        flat = [d for p in paths for d in p]
        self.node = np.array([d[0] for d in flat], np.int64)
        self.bit = np.array([d[1] for d in flat], np.int64)


def slots(hashes: list[np.ndarray | None], node: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Each predictor's slot for each decision, from its context's hash (none: the node itself)."""
    node_code = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for h in hashes:
        x = node_code if h is None else h.take(owner) + node_code
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        out.append((x >> np.uint64(64 - SLOT_BITS)).view(np.int64))
    return out


class Lexicon:
    """What is fixed before counting: the dictionary and the two codes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, end: int, escaped: int, byte_counts: np.ndarray):
        order = np.argsort(words)
        self.words = words[order]
        self.end, self.escape = len(words), len(words) + 1
        self.word_code = Code(np.append(counts[order], [end, escaped]))
        self.byte_code = Code(byte_counts)

    def symbols(self, code: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(code), self.escape)
        at = np.minimum(np.searchsorted(self.words, code), len(self.words) - 1)
        return np.where(self.words[at] == code, at, self.escape)

    def word_level(self, t: Tokens, of: np.ndarray):
        """Symbols of the texts ``of``, their ends included, each symbol's text, and its contexts' hashes."""
        count = t.count[of]
        n = count + 1
        owner = np.repeat(np.arange(len(of)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        is_end = place == count[owner]
        at = np.minimum(t.first[of][owner] + place, max(len(t.code) - 1, 0))
        code = np.where(is_end, np.uint64(1), t.code[at] if len(t.code) else np.uint64(1))
        symbol = np.where(is_end, self.end, self.symbols(code))
        one, two = np.full(len(code), _START), np.full(len(code), _START)
        one[1:], two[2:] = code[:-1], code[:-2]
        one[place < 1], two[place < 2] = _START, _START
        return symbol, owner, at, [None, mix(one + np.uint64(1)), mix(mix(two + np.uint64(2)) + one), mix(two + np.uint64(3))]

    def spelling(self, t: Tokens, word: np.ndarray):
        """Symbols (bytes and an end) of the words at ``word``, each one's word, and its contexts' hashes."""
        length = t.stop[word] - t.start[word]
        n = length + 1
        owner = np.repeat(np.arange(len(word)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        is_end = place == length[owner]
        symbol = np.where(is_end, 256, t.data[np.minimum(t.start[word][owner] + place, max(len(t.data) - 1, 0))].astype(np.int64)) if len(t.data) else np.zeros(0, np.int64)
        hashes, h = [], np.full(len(symbol), np.uint64(257))
        for back in range(1, 5):
            before = np.full(len(symbol), 256, np.int64)
            before[back:] = symbol[:-back]
            before[place < back] = 256
            h = mix(h * np.uint64(263) + before.astype(np.uint64) + np.uint64(back))
            if back != 3:
                hashes.append(h)
        begin = t.start[word][owner]
        so_far = Sums(BYTE_CODE[t.data]).of(begin, begin + place) if len(symbol) else h
        return symbol, owner, [*hashes, mix(so_far + place.astype(np.uint64))]


def decisions(code: Code, symbol: np.ndarray, hashes: list, chunk: int = CHUNK):
    """Chunks of symbols as decisions: (index of the symbol, bit, slots by table)."""
    step = max(1, chunk // max(1, int(np.ceil(code.length[symbol].mean())))) if len(symbol) else 1
    for a in range(0, len(symbol), step):
        s = symbol[a : a + step]
        n = code.length[s]
        owner = np.repeat(np.arange(len(s)), n)
        at = code.offset[s][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        yield owner + a, code.bit[at], slots([None if h is None else h[a : a + step] for h in hashes], code.node[at], owner)


def escaped_words(lexicon: Lexicon, t: Tokens, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct escaped words (a place of each), how often each occurs among the symbols, and each escaped symbol's word."""
    which = at[symbol == lexicon.escape]
    _, first, back = np.unique(t.code[which], return_index=True, return_inverse=True)
    return which[first], np.bincount(back, minlength=len(first)), back


def _counts(lexicon):
    """Of all training texts: how often each slot of each table saw a 0 and a 1; chunks of the tables as rows."""

    def run(batches):
        lex = lexicon.value
        table = np.zeros((TABLES, SLOTS, 2))
        for rows, texts in shards(batches, SHARD):
            t = Tokens(rows, texts)
            symbol, _, _, hashes = lex.word_level(t, np.flatnonzero(~t.held))
            for _, bit, slot in decisions(lex.word_code, symbol, hashes, COUNTED):
                for k in range(TABLES):
                    table[k] += np.bincount(slot[k] * 2 + bit, minlength=2 * SLOTS).reshape(-1, 2)
        yield from _table_parts(table, 0)

    return run


def _count_spelling(lexicon):
    """The same for the spelling of the escaped words of the whole corpus, each as often as it occurs in training."""

    def run(batches):
        lex, table = lexicon.value, np.zeros((TABLES, SLOTS, 2))
        for t, word, times in lexicon_rows(lex, batches):
            symbol, owner, hashes = lex.spelling(t, word)
            for i, bit, slot in decisions(lex.byte_code, symbol, hashes, COUNTED):
                weight = times[owner[i]]
                for k in range(TABLES):
                    table[k] += np.bincount(slot[k] * 2 + bit, weight, minlength=2 * SLOTS).reshape(-1, 2)
        yield from _table_parts(table, 1)

    return run


def lexicon_rows(lex: Lexicon, batches):
    """From rows of words and training counts: the words as tokens, which of them training escapes, and how often."""
    for b in batches:
        for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = Tokens(pa.table({"doc_id": [0]}), [words])
            times = np.frombuffer(counts, np.uint32)
            at = np.flatnonzero((lex.symbols(t.code) == lex.escape) & (times > 0))
            yield t, at, times[at].astype(float)


def _table_parts(table: np.ndarray, level: int):
    parts = table.astype(np.uint32).reshape(PARTS // 2, -1)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array((used + level * (PARTS // 2)).astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "counts"])


PARTS = 64


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            add = np.frombuffer(counts, np.uint32).astype(np.int64) if len(counts) == SIZE_32 else np.frombuffer(counts, np.int64)
            total[part] = total[part] + add if part in total else add
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])


SIZE_32 = 2 * TABLES * SLOTS * 2 // PARTS * 4


class Predictors:
    """Log-odds and a class of confidence for every slot: as they are, and with a 0 or a 1 left out."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(float)  # (2, TABLES, SLOTS, 2)
        odds = lambda n0, n1: np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)
        trust = lambda n: np.searchsorted([0.5, 3.5, 31.5], n, side="right").astype(np.int8)
        n0, n1 = c[..., 0], c[..., 1]
        self.odds, self.trust = odds(n0, n1), trust(n0 + n1)
        less = np.maximum(n0 - 1, 0), np.maximum(n1 - 1, 0)
        self.without = np.stack((odds(less[0], n1), odds(n0, less[1])), -1).reshape(2, TABLES, -1)
        self.trust_less = trust(n0 + n1 - 1)

    def look(self, level: int, slot: list[np.ndarray], bit: np.ndarray | None):
        """The predictors' log-odds and the gate; with ``bit``, as if this decision had not been counted."""
        a, b = (3, 2) if level else (2, 1)
        if bit is None:
            return [self.odds[level, k].take(slot[k]) for k in range(TABLES)], self.trust[level, a].take(slot[a]) * 4 + self.trust[level, b].take(slot[b])
        return [self.without[level, k].take(slot[k] * 2 + bit) for k in range(TABLES)], self.trust_less[level, a].take(slot[a]) * 4 + self.trust_less[level, b].take(slot[b])


def blend(x: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = weights.astype(np.float32)
    z = np.ascontiguousarray(w[:, 0]).take(gate) * x[0]
    for k in range(1, TABLES):
        z += np.ascontiguousarray(w[:, k]).take(gate) * x[k]
    return np.clip(z, -12, 12)


def bins(gate: np.ndarray, z: np.ndarray) -> np.ndarray:
    return gate.astype(np.int64) * BINS + (np.rint(np.clip(z, -8, 8) * 2) + BINS // 2).astype(np.int64)


WEIGHTED = "level int, gate int, weight array<double>, seen double, ones array<double>, times array<double>"


def _weigh(lexicon, predictors, level: int):
    """Online weights over all training texts (level 0) or escaped words (level 1) of a partition, and what came true for each gate and blend."""

    def run(batches):
        lex, tables = lexicon.value, predictors.value
        weights = np.full((GATES, TABLES), 0.35)
        seen, ones, times = np.zeros(GATES), np.zeros(GATES * BINS), np.zeros(GATES * BINS)

        def learn(code, symbol, hashes, weight):
            for i, bit, slot in decisions(code, symbol, hashes):
                m = None if weight is None else weight[i]
                x, gate = tables.look(level, slot, bit)
                z = blend(x, gate, weights)
                p = 1 / (1 + np.exp(-z))
                at = bins(gate, z)
                times[:] += np.bincount(at, m, GATES * BINS)
                ones[:] += np.bincount(at, bit if m is None else bit * m, GATES * BINS)
                seen[:] += np.bincount(gate, m, GATES)
                miss, spread = bit - p, p * (1 - p)
                if m is not None:
                    miss, spread = miss * m, spread * m
                for k in range(TABLES):
                    up = np.bincount(gate, miss * x[k], GATES)
                    weights[:, k] += up / (TABLES * np.bincount(gate, spread * x[k] * x[k], GATES) + 1.0)

        if level:
            for t, word, often in lexicon_rows(lex, batches):
                symbol, owner, hashes = lex.spelling(t, word)
                learn(lex.byte_code, symbol, hashes, often[owner])
        else:
            for rows, texts in shards(batches, SHARD):
                t = Tokens(rows, texts)
                symbol, _, _, hashes = lex.word_level(t, np.flatnonzero(~t.held))
                learn(lex.word_code, symbol, hashes, None)
        cut = lambda x: [x[g * BINS : (g + 1) * BINS].tolist() for g in range(GATES)]
        cols = [pa.array([level] * GATES, pa.int32()), pa.array(list(range(GATES)), pa.int32()), pa.array(weights.tolist()), pa.array(seen.tolist()), pa.array(cut(ones)), pa.array(cut(times))]
        yield pa.RecordBatch.from_arrays(cols, ["level", "gate", "weight", "seen", "ones", "times"])

    return run


def _score(lexicon, predictors, final, kind: str):
    """log10 of the model's probability of each text."""

    def run(batches):
        lex, tables = lexicon.value, predictors.value
        weights, truth, name = final.value
        if name not in _SPELLED:  # words that earlier shards of this worker have spelled with this model
            _SPELLED.clear()
            _SPELLED[name] = np.zeros(0, np.uint64), np.zeros(0)

        def cost(level, code, symbol, hashes, groups, owner):
            out = np.zeros(groups)
            for i, bit, slot in decisions(code, symbol, hashes):
                x, gate = tables.look(level, slot, None)
                z = blend(x, gate, weights[level])
                p = 0.5 / (1 + np.exp(-z)) + 0.5 * truth[level][bins(gate, z)]
                out += np.bincount(owner[i], np.log10(np.where(bit == 1, p, 1 - p)), groups)
            return out

        for rows, texts in shards(batches, SHARD):
            t = Tokens(rows, texts)
            symbol, owner, at, hashes = lex.word_level(t, np.arange(len(texts)))
            score = cost(0, lex.word_code, symbol, hashes, len(texts), owner)
            word, _, back = escaped_words(lex, t, symbol, at)
            code = t.code[word]  # distinct and sorted
            seen, costs = _SPELLED[name]
            slot = np.minimum(np.searchsorted(seen, code), max(len(seen) - 1, 0))
            known = seen[slot] == code if len(seen) else np.zeros(len(code), bool)
            letters, of, hashes = lex.spelling(t, word[~known])
            spelled = np.zeros(len(word))
            spelled[known] = costs[slot[known]]
            spelled[~known] = cost(1, lex.byte_code, letters, hashes, int((~known).sum()), of)
            if len(seen) + len(code) <= REMEMBERED:
                seen, costs = np.concatenate((seen, code[~known])), np.concatenate((costs, spelled[~known]))
                order = np.argsort(seen, kind="stable")
                _SPELLED[name] = seen[order], costs[order]
            score += np.bincount(owner[symbol == lex.escape], spelled[back], len(texts))
            size = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows["row"].combine_chunks(), rows["doc_id"].combine_chunks(), size, pa.array(score)], ["row", "doc_id", "n_bytes", "score"])

    return run, f"row long, doc_id {kind}, n_bytes long, score double"


def _within(length: np.ndarray) -> np.ndarray:
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def score_texts(docs: DataFrame) -> DataFrame:
    """Every document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose crc32 of the doc_id as text is 0 modulo 10 are held out, all others train (a null doc_id counts as the
    empty text, so is held out). A null or empty text is the end alone; n_bytes 0 gives null bits_per_byte. Without any
    training text every decision is even. Repeated rows are answered alike and each counts in training.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = keyed(docs)
    rows = texts.select("row", "doc_id", "text")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = staged(rows.mapInArrow(_ask(buckets), ASKED).repartition("bucket").mapInArrow(_answer, ANSWERED), "lm-words")
    base = staged(answers.where("kind = 0").select("shard", "base", "known", "meta").repartition("shard").mapInArrow(_sum_up, "row long, held_out boolean, n_words long, known long, base double"), "lm-base")
    lists = answers.where("kind = 1")
    sums = lists.agg(F.sum("vocabulary").alias("v"), F.sum("tokens").alias("n")).first()
    ends = base.where("not held_out").count()
    vocabulary, tokens = (sums["v"] or 0) + (ends > 0), (sums["n"] or 0) + ends
    # each partition has so many words of at least ``often`` that all have WORDS together: the most frequent are among those
    share = -(-WORDS // max(lists.count(), 1))
    often = lists.agg(F.min(F.coalesce(F.get("counts", F.lit(share - 1)), F.lit(0)))).first()[0] or 0
    top = lists.select(F.explode(F.filter(F.arrays_zip("codes", "counts"), lambda x: x["counts"] >= often)).alias("x")).select("x.codes", "x.counts").orderBy(F.desc("counts"), "codes").limit(WORDS).collect()
    words, counts = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    letters = np.zeros(257, np.int64)
    for r in answers.where("kind = 2").select(F.explode(F.arrays_zip("codes", "counts")).alias("x")).groupBy("x.codes").agg(F.sum("x.counts").alias("n")).collect():
        letters[r["codes"]] = r["n"]
    lexicon = sc.broadcast(Lexicon(words, counts, ends, max(int(letters[256] - counts.sum()), 0), letters))
    table = np.zeros((PARTS, SIZE_32 // 4), np.int64)
    spelled = answers.where("kind = 3").select(F.col("base").alias("words"), F.col("known").alias("counts")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.mapInArrow(_counts(lexicon), "part int, counts binary").union(spelled.mapInArrow(_count_spelling(lexicon), "part int, counts binary"))
    for r in counted.repartition("part").mapInArrow(_add, "part int, counts binary").collect():  # the tables, of fixed size
        table[r["part"]] = np.frombuffer(r["counts"], np.int64)
    predictors = sc.broadcast(Predictors(table.reshape(2, TABLES, SLOTS, 2)))
    each = rows.mapInArrow(_weigh(lexicon, predictors, 0), WEIGHTED).union(spelled.mapInArrow(_weigh(lexicon, predictors, 1), WEIGHTED))
    weights, truth = np.full((2, GATES, TABLES), 0.35), np.zeros((2, GATES, BINS))
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(BINS)]).alias(c)
    sums = each.groupBy("level", "gate").agg(F.sum("seen").alias("seen"), F.array(*[F.sum(F.col("weight")[k] * F.col("seen")) for k in range(TABLES)]).alias("weight"), add("ones"), add("times")).collect()
    expected = 1 / (1 + np.exp(-(np.arange(BINS) - BINS // 2) / 2))
    truth[:] = expected
    for r in sums:
        at = r["level"], r["gate"]
        if r["seen"]:
            weights[at] = np.round(np.array(r["weight"]) / r["seen"], 6)
        truth[at] = (np.array(r["ones"]) + 10 * expected) / (np.array(r["times"]) + 10)
    final = sc.broadcast((weights, truth.reshape(2, -1), uuid.uuid4().hex))
    scored = rows.mapInArrow(*_score(lexicon, predictors, final, docs.schema["doc_id"].dataType.simpleString()))
    out = scored.join(base.dropDuplicates(["row"]), "row")
    n = F.col("n_words") + 1
    below = float(np.log10(tokens + 0.1 * (vocabulary + 1)))
    return out.select(
        "doc_id", "held_out", n.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 0.1)) - n * below).alias("base_score"), "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
