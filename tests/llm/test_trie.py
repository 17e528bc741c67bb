"""The prefix trie against a plain dictionary of prefixes."""

from motionloom.llm import trie

from . import conversations as brute

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def answer(spark, rows):
    return sorted(tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, brute.SCHEMA).repartition(5)).select(*COLUMNS).collect())


def test_awkward_conversations(spark):
    rows = brute.rows()
    got, want = answer(spark, rows), brute.trie(rows)
    assert len(got) > 1000 and got == want


def test_one_conversation_and_none(spark):
    rows = [(7, 1, "user", "a.", None, None, None)]
    assert answer(spark, rows) == brute.trie(rows)
    assert answer(spark, []) == [] and answer(spark, [(None, 1, "user", "a", None, None, None)]) == []


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}", None, None, None) for c in range(0, 9000, 5) for t in range(3)]
    assert answer(spark, rows) == brute.trie(rows)


def test_two_sequences_that_part_at_the_end(spark):
    rows = [(c, t, "user", f"t{t if t < 99 else c}", None, None, None) for c in (0, 5, 10) for t in range(100)]
    assert answer(spark, rows) == brute.trie(rows)
