"""Shards that hold the same rows in the same order: a table united with itself, and rows that fill a shard each."""

import math
import zlib

import pytest

from motionloom.llm import jaccard, mixlm, tokens

from . import brute


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def filling(spark):
    """One partition of equal rows, each a shard by itself."""
    text = "alpha beta gamma delta " * (tokens.SHARD_BYTES // 23 + 1)
    return spark.createDataFrame([(4, text)] * 3 + [(5, "alpha beta")], "doc_id long, text string").coalesce(1)


def test_jaccard_of_a_table_twice(docs, rows):
    want = brute.components(rows, 3, 90, 100)
    text = {r[0]: r[1] or "" for r in rows}
    back = lambda x: None if x == jaccard.ABSENT else x
    got = [(back(r["doc"]), r["n_shingles"], back(r["component"])) for r in jaccard.jaccard_components(docs.union(docs), 3, (90, 100)).collect()]
    expected = [(r[0], *want[r[0], text[r[0]]]) for r in rows * 2]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_jaccard_of_rows_that_fill_a_shard(filling):
    got = sorted((r["doc"], r["n_shingles"], r["component"]) for r in jaccard.jaccard_components(filling, 3, (90, 100)).collect())
    assert got == [(4, 4, 4)] * 3 + [(5, 1, 5)]


def test_lm_base_score_of_a_table_twice(docs, rows):
    words = lambda t: [*(t or "").encode().translate(brute.LOWER).split(), None]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c = brute.counts(w for r in rows * 2 if not held(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    text = {r[0]: r[1] for r in rows}
    got = mixlm.score_texts(docs.union(docs)).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        w = words(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
