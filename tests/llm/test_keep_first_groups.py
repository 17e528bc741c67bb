"""Groups of near copies that share no link but have one least doc_id."""

import random

from motionloom.llm import jaccard


def test_unlinked_texts_with_one_doc_id_stay(spark):
    rng = random.Random(8)
    prose = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(6)]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (5, prose[3]), (5, prose[4]), (6, prose[3]), (7, prose[5]), (8, prose[0] + " end"), (None, prose[1]), (9, ""), (None, None)]
    got = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (5, prose[3]), (5, prose[4]), (7, prose[5]), (9, ""), (None, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
