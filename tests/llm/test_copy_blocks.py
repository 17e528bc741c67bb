"""Reference blocks of op5 are made by anchor: what cannot match is not compared, however many blocks a partition holds."""

import random

import pyarrow as pa
import pytest

from motionloom.llm import lempelziv

from . import brute


def bodies(rng, grams, each, words, common):
    """BODY rows, sorted by anchor: each anchor's bodies share a run of ``common`` words at its own place."""
    rows = []
    for gram in range(grams):
        run = [f"c{gram}_{i}" for i in range(common)]
        for i in range(each):
            before = rng.randrange(5, words - common)
            text = [f"w{rng.randrange(10**6)}" for _ in range(before)] + run + [f"w{rng.randrange(10**6)}" for _ in range(words - common - before)]
            rows.append((gram, gram * each + i, gram * each + i, before, 0, words, [before], " ".join(text).encode()))
    names = ["gram", "row", "doc", "pos", "low", "high", "places", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def spans(batch, size, window=50):
    found = [r for b in lempelziv._resolve(window, size)([batch.slice(i, 7) for i in range(0, batch.num_rows, 7)]) for r in zip(*b.to_pydict().values())]
    return sorted(found)


@pytest.mark.parametrize("common", [50, 60, 40])
def test_spans_do_not_depend_on_the_blocks(common):
    batch = bodies(random.Random(common), 6, 12, 80, common)
    want = sorted((r["row"], r["pos"], r["pos"] + common) for r in batch.to_pylist() if r["row"] % 12 and common >= 50)
    for size in (1 << 10, 1 << 13, 1 << 23):
        assert spans(batch, size) == want


def test_work_is_linear_in_the_blocks_of_a_partition(monkeypatch):
    seen = []
    real = lempelziv._match
    monkeypatch.setattr(lempelziv, "_match", lambda codes, *a: seen.append(len(codes)) or real(codes, *a))
    work = {}
    for grams in (20, 80):
        batch = bodies(random.Random(1), grams, 6, 80, 60)
        seen.clear()
        spans(batch, 1 << 12)
        work[grams] = sum(seen)
    assert work[80] < 6 * work[20]  # every pair of blocks would be about 16 times
    hot = {}
    for each in (50, 200):  # one anchor far larger than a block
        seen.clear()
        spans(bodies(random.Random(2), 1, each, 80, 60), 1 << 13)
        hot[each] = sum(seen)
    assert hot[200] < 6 * hot[50]


def test_bodies_without_a_common_window_are_not_factored(monkeypatch):
    monkeypatch.setattr(lempelziv, "_match", lambda *a: pytest.fail("nothing can match"))
    assert spans(bodies(random.Random(3), 3, 40, 80, 30), 1 << 12) == []


def test_a_common_phrase_in_many_documents(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(10**7)}"
    phrase, passage = [word() for _ in range(14)], [word() for _ in range(70)]
    rows = []
    for i in range(120):
        middle = passage[i % 9:] if i % 4 == 0 else phrase
        rows.append((i % 100, " ".join([word() for _ in range(60)] + middle + [word() for _ in range(60)]), "en", "s", 1, "r", "d", i))
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    want = brute.copies_of_words(rows, 50)
    got = lempelziv.remove_copies(docs, size=1 << 12).collect()
    assert len(got) == 120
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    for d, found in texts.items():
        assert sorted(found) == sorted(w[:2] for (doc, _), w in want.items() if doc == d)
    assert any(n for found in texts.values() for _, n in found)
