"""Words that a polynomial hash takes for each other are told apart by all operators that code words."""

import zlib

import numpy as np
import pytest
import sentencepiece

from motionloom.llm import jaccard, lempelziv, mixlm, queries, tokencount, tokens

SWAP = str.maketrans("xq", "qx")


def arranged(doublings: int) -> tuple[str, str]:
    """A word whose halves are each other's complement, at every scale, and its own complement."""
    w = "x"
    for _ in range(doublings):
        w += w.translate(SWAP)
    return w, w.translate(SWAP)


@pytest.fixture(scope="module")
def twins():
    return arranged(10)


def test_codes_of_arranged_letters():
    words = [w.encode() for k in range(14) for w in arranged(k)]
    data, start, stop = tokens.joined(words)
    assert len(set(tokens.word_codes(data, start, stop).tolist())) == len(set(words)) == 28


def test_codes_follow_bytes_and_nothing_else():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(0, 40, 3000)] + [b"a" * n for n in range(40)] + [b"\x00" * n for n in range(40)]
    data, start, stop = tokens.joined(words)
    code = dict(zip(words, tokens.word_codes(data, start, stop).tolist()))
    assert len(set(code.values())) == len(code)
    again = tokens.word_codes(*tokens.joined(words[::-1])).tolist()[::-1]
    assert [code[w] for w in words] == again
    assert tokens.word_codes(*tokens.joined([])).tolist() == []


def test_token_counts_of_twins(spark, twins):
    path = queries.tokenizer_path()
    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, f"{w} and {w}") for i, w in enumerate([*twins, *arranged(9), *twins])]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path).collect()}
    assert got == {i: len(encoder.encode(t)) for i, t in rows}


def test_jaccard_of_twins(spark, twins):
    x, y = twins
    rows = [(1, f"one two {x}"), (2, f"one two {y}"), (3, f"one two {x}"), (4, y)]
    got = {r["doc"]: r["component"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_copies_of_twins(spark, twins):
    words = [f"w{i}" for i in range(49)]
    texts = [" ".join([*words[:25], w, *words[25:]]) for w in (*twins, twins[0])]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"]).decode()) for r in lempelziv.remove_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, texts[0]), 1: (0, texts[1]), 2: (50, "")}


def test_known_words_of_twins(spark, twins):
    """One twin is in the training texts; a held-out text knows it, one with the other twin knows the end only."""
    train = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10)
    held = [i for i in range(999) if not zlib.crc32(str(i).encode()) % 10][:2]
    rows = [(train, twins[0]), (held[0], twins[0]), (held[1], twins[1])]
    got = {r["doc_id"]: r["n_known"] for r in mixlm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {train: 2, held[0]: 2, held[1]: 1}
