"""Plain single-machine versions of the operators, and documents with awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, w int"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Invented prose with copies, near copies, shared passages, repeats inside a text, nulls, empty and very long texts, and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéstn") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(k))
    passage, texts = prose(90), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append(prose(rng.randint(0, 60)) + " " + passage + " " + prose(rng.randint(0, 60)))
        elif kind == 4:
            part = prose(70)
            texts.append(part + "\n" + prose(5) + "\n" + part)
        else:
            texts.append(prose(rng.randint(1, 300)))
    texts += ["", " \n\t ", "a", "One two", "ONE TWO", passage, "x" * 350, "日本 テスト 😀 " * 60, prose(6000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(3 * d, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(t), "x", "y", 1) for d, t in zip(order, texts, strict=True)]
    return [*rows, (1000, None, None, None, None, None, None, None), (None, texts[0], "en", "s0", 1, "x", "y", 1), rows[7], rows[7]]


def rank(doc_id):
    return -(2**63) if doc_id is None else doc_id


def distinct(rows):
    """(doc_id, text) of the documents in order, repeated rows once."""
    return sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (rank(r[0]), r[1]))


def runs(covered):
    return sum(1 for i in range(len(covered)) if covered[i] and (i == 0 or not covered[i - 1]))


def repeats_of_bytes(rows, window):
    first, out = set(), {}
    for doc_id, text in distinct(rows):
        data = text.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - window + 1):
            gram = data[i : i + window]
            if gram in first:
                covered[i : i + window] = b"\1" * window
            first.add(gram)
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        out[doc_id, text] = (len(data), sum(covered), runs(covered), hashlib.sha256(kept).hexdigest())
    return out


def copies_of_words(rows, window):
    first, out = {}, {}
    for doc_id, text in distinct(rows):
        words = text.encode().split()
        covered = bytearray(len(words))
        for i in range(len(words) - window + 1):
            gram = tuple(words[i : i + window])
            if first.setdefault(gram, rank(doc_id)) < rank(doc_id):
                covered[i : i + window] = b"\1" * window
        kept = b" ".join(x for x, c in zip(words, covered, strict=True) if not c)
        out[doc_id, text] = (len(words), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k):
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def components(rows, k, p, q):
    docs = distinct(rows)
    sets, parent = [shingles(t, k) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and q * common >= p * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), docs[find(i)][0]) for i, (d, s) in enumerate(zip(docs, sets, strict=True))}


def counts(words):
    return Counter(words)
