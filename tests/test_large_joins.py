"""Joins whose per-key side grows like the rows, and texts that are long."""

import time


from motionloom.operators import joins as J
from motionloom.operators import quality as Q
from motionloom.operators.ordered import spread_join
from motionloom.plans.q_quality import audit_left_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_copied_into_a_broadcast(spark):
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    got = spread_join(rows, one, ["k"], large=True)
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a"), (2, None), (None, None)]


def test_audit_left_join_shuffles_its_tables(spark, tmp_path):
    q = spark.createDataFrame([(1, 5, 0), (2, 6, 0), (3, None, 0)], "recording long, source_id long, device_id long")
    split = spark.createDataFrame([(5, 0, "train"), (6, 1, "test")], "source_id long, device_id long, split string")
    log = spark.createDataFrame([(1, 2), (1, 3), (9, 1)], "recording long, repaired long")
    q, split, log = (J.staged(x, "t") for x in (q, split, log))
    got = audit_left_join(q, split, log, ["source_id", "device_id"], "recording", ["repaired"])
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted(map(tuple, got.select("recording", "split", "repaired", "log_rows").collect())) == [(1, "train", 5, 2), (2, None, None, None), (3, None, None, None)]


def test_inherit_split_and_source_format_shuffle_their_tables(spark):
    o = J.staged(spark.createDataFrame([(1, 5), (2, 6), (3, None)], "o long, subject long"), "t")
    sp = J.staged(spark.createDataFrame([(5, "test"), (5, "train")], "subject long, split string"), "t")
    got = J.inherit_split(o, sp, "subject")
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted(tuple(r) for r in got.select("o", "split", "formal_evaluation").collect()) == [(1, "train", False), (2, "unassigned", False), (3, "unassigned", False)]
    recs = J.staged(spark.createDataFrame([(1, "g", "csv"), (2, "g", "txt"), (3, "h", "txt"), (4, "h", "bin"), (5, "h", "txt")], "r long, s string, f string"), "t")
    got = Q.prefer_source_format(recs, ["s"], "f", {"csv": 0, "txt": 1})
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted(r["r"] for r in got.collect()) == [1, 3, 5]


def test_contains_first_is_linear_in_a_text(spark):
    far = "".join(chr(0x4E00 + i % 5000) for i in range(200_000))
    docs = spark.createDataFrame([(1, far + "needle"), (2, far + "needl"), (3, "x\n\U0001F600b\n"), (4, ""), (5, None), (6, "a]^-b")], "id long, text string")
    terms = spark.createDataFrame([(1, "needle", "n"), (2, "\U0001F600b", "smile"), (3, "^-", "marks"), (None, "x", "never")], "ordinal int, term string, value string")
    start = time.time()
    got = {r["id"]: r["value"] for r in J.contains_first(docs, "text", terms).collect()}
    assert got == {1: "n", 2: None, 3: "smile", 4: None, 5: None, 6: "marks"}
    assert time.time() - start < 60  # quadratic work on the long texts takes minutes
    empty = spark.createDataFrame([(2, "", "any"), (1, "b", "b")], "ordinal int, term string, value string")
    assert {r["id"]: r["value"] for r in J.contains_first(docs, "text", empty).collect()} == {1: "any", 2: "any", 3: "b", 4: "any", 5: None, 6: "b"}
