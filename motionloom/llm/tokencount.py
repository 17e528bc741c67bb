"""Token counts by prefix dynamic programming over a subword vocabulary merged by pairs.

Of all tokens that a prefix of a text can end with, exactly one fits the encoder's result: the one that stays whole
beside the last token of the prefix before it. So last token and count of each prefix follow from shorter prefixes,
and answer questions about truncation and budgets without encoding again. Tokens never cross the start of a run
of spaces or a line break, so the table is made once for each distinct stretch between those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import BYTE_CODE, Sums, mix, shards, word_codes

#: Bytes of text whose distinct stretches share a table, and distinct stretches whose totals a worker remembers.
SHARD, REMEMBERED = 6 << 20, 1_500_000
_BAR = "▁"
_BREAKS = np.zeros(256, bool)
_BREAKS[[9, 10]] = True
_PAIRS = 1 << 22
_MODELS: dict[str, Model] = {}


class Model:
    """The vocabulary of a sentencepiece BPE model, and which of its tokens stand side by side."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.text = {i: self.sp.id_to_piece(i).replace(_BAR, " ") for i in plain}
        singles = {t for t in self.text.values() if len(t) == 1}
        assert all(set(t) <= singles and " " not in t.lstrip(" ") and not set(t) & set("\t\n") for t in self.text.values()), "a vocabulary of another kind"
        self.longest = max(map(len, self.text.values()))
        raw = [self.text[i].encode() for i in plain]
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(x) for x in raw])
        code = _code(Sums(BYTE_CODE[data]), end - [len(x) for x in raw], end)
        order = np.argsort(code)
        self.code, self.id = code[order], np.array(plain)[order]
        self.alone = np.zeros(n, bool)  # stays whole by itself
        self.alone[plain] = [r == [i] for i, r in zip(plain, self._encode([self.text[i] for i in plain]), strict=True)]
        self.key, self.fits = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)
        self.seen, self.total = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        # a line break before keeps the encoder from adding its leading space to the text itself
        return [r[2:] for r in self.sp.encode(["\n" + t for t in texts], num_threads=1)]

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b next to each other stay as they are; what was asked before is looked up."""
        key = a << 20 | b
        slot = (mix(key.astype(np.uint64)) % np.uint64(_PAIRS)).astype(np.int64)
        out, new = self.fits[slot], self.key[slot] != key
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            x, y = (keys >> 20).tolist(), (keys & 0xFFFFF).tolist()
            got = self._encode([self.text[i] + self.text[j] for i, j in zip(x, y, strict=True)])
            fit = np.array([r == [i, j] for i, j, r in zip(x, y, got, strict=True)], bool)
            out[new] = fit[back]
            at = slot[new]
            self.key[at], self.fits[at] = key[new], fit[back]
            # where two keys share a slot the last one written stays: its answer must be its own
            clash = self.key[at] != key[new]
            self.fits[at[~clash]] = fit[back][~clash]
        return out


def _code(sums: Sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return sums.of(start, end) ^ mix((np.asarray(end) - np.asarray(start)).astype(np.uint64))


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def prefix_table(m: Model, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches [begin, end) of ``data`` that tile it: tokens at the end of every character's prefix, and the characters' ends."""
    first_byte = np.flatnonzero((data & 0xC0) != 0x80)
    char_end = np.append(first_byte[1:], len(data))
    head = np.searchsorted(first_byte, begin)
    length = np.searchsorted(first_byte, end) - head
    sums = Sums(BYTE_CODE[data])
    count, last = np.zeros(len(first_byte), np.int32), np.full(len(first_byte), -1)
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    for t in range(int(length[0]) if len(length) else 0):
        lanes = head[: np.searchsorted(-length, -t)]  # those longer than t
        at = lanes + t
        rest = np.arange(len(at))
        for size in range(1, min(m.longest, t + 1) + 1):
            start = at[rest] - size + 1
            code = _code(sums, first_byte[start], char_end[at[rest]])
            slot = np.minimum(np.searchsorted(m.code, code), len(m.code) - 1)
            is_token = m.code[slot] == code
            cand, token = rest[is_token], m.id[slot[is_token]]
            begins = np.full(len(cand), size == t + 1)
            before = last[at[cand] - size] if size <= t else np.full(len(cand), -1)
            fits = m.alone[token].copy()
            pair = np.flatnonzero(~begins & (before >= 0))
            fits[pair] = m.beside(before[pair], token[pair])
            cand, token = cand[fits], token[fits]
            last[at[cand]] = token
            count[at[cand]] = 1 + (count[at[cand] - size] if size <= t else 0)
            open_ = np.ones(len(at), bool)
            open_[cand] = False
            rest = rest[open_[rest]]
            if not len(rest):
                break
        # a character that no token has is written byte by byte and never merged
        count[at[rest]] = char_end[at[rest]] - first_byte[at[rest]] + (count[at[rest] - 1] if t else 0)
    return count, char_end


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each with the encoder's leading space, as bytes; their stretches' starts and ends; each text's first stretch."""
    texts = [x.replace(_BAR.encode(), b" ") for x in texts]
    data = np.frombuffer(b"".join(b" " + x if x else b"" for x in texts), np.uint8)
    length = np.fromiter((len(x) + 1 if x else 0 for x in texts), np.int64, len(texts))
    begin = np.cumsum(length) - length
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    space, broken = data == 32, _BREAKS[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | broken[1:] | broken[:-1]
    cut[begin[length > 0]] = True
    start = np.flatnonzero(cut)
    return data, start, np.append(start[1:], len(data)), np.append(np.searchsorted(start, begin), len(start))


def totals(m: Model, texts: list[bytes]) -> np.ndarray:
    """Tokens of each text."""
    data, start, end, first = stretches(texts)
    code = word_codes(data, start, end)
    kinds, at, back = np.unique(code, return_index=True, return_inverse=True)
    slot = np.minimum(np.searchsorted(m.seen, kinds), max(len(m.seen) - 1, 0))
    known = m.seen[slot] == kinds if len(m.seen) else np.zeros(len(kinds), bool)
    value = np.zeros(len(kinds), np.int32)
    value[known] = m.total[slot[known]]
    new = np.flatnonzero(~known)
    if len(new):
        flat, begin, stop = gathered(data, start[at[new]], end[at[new]])
        count, char_end = prefix_table(m, flat, begin, stop)
        value[new] = count[np.searchsorted(char_end, stop)]
        if len(m.seen) + len(new) <= REMEMBERED:
            seen, total = np.concatenate((m.seen, kinds[new])), np.concatenate((m.total, value[new]))
            order = np.argsort(seen, kind="stable")
            m.seen, m.total = seen[order], total[order]
    upto = np.concatenate(([0], np.cumsum(value[back])))
    return upto[first[1:]] - upto[first[:-1]]


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches [start, end) of ``data`` side by side, and where they begin and end there."""
    length = end - start
    stop = np.cumsum(length)
    place = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)
    return data[place], stop - length, stop


def prefix_counts(m: Model, text: bytes) -> list[int]:
    """Tokens of every prefix of a text, by characters; the first is the empty prefix's 0."""
    data, start, end, _ = stretches([text])
    if not len(data):
        return [0]
    count, char_end = prefix_table(m, data, start, end)
    whole = np.searchsorted(char_end, end)
    base = np.concatenate(([0], np.cumsum(count[whole])[:-1]))
    out = count + base[np.searchsorted(end, char_end)]
    out[0] = 0  # only the encoder's own space so far
    return out.tolist()


def _count(path: str, prefixes: bool):
    def run(batches):
        m = model(path)
        for rows, texts in shards(batches, SHARD):
            cols = [rows["doc_id"].combine_chunks(), pa.array(list(map(len, texts)), pa.int64()), pa.array(totals(m, texts).astype(np.int64))]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if prefixes:
                cols.append(pa.array([prefix_counts(m, x) for x in texts], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def token_counts(docs: DataFrame, path: str, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document row, as the encoder of the model at ``path`` counts them.

    With ``prefixes`` also prefix_tokens: the exact count of the first 0, 1, 2 ... characters. A null or empty text has
    none; rows stay as many as they are; other columns are ignored. ``path`` must be readable on all executors.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(path, prefixes), f"doc_id {kind}, n_bytes long, n_tokens long" + ", prefix_tokens array<int>" * prefixes)


def characters_within(prefix_tokens: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
