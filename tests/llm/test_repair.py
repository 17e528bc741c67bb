"""Repairs against a plain backward search over whole audits."""

import pytest

from motionloom.llm import repair

from . import conversations as brute

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answer(spark, rows, size):
    out = repair.repair_damaged(spark.createDataFrame(rows, brute.SCHEMA).repartition(5), size).collect()
    assert len(out) == len({r["conv_id"] for r in out})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out}


@pytest.mark.parametrize("size", [repair.BLOCK, 3])
def test_awkward_conversations(spark, size):
    rows = brute.rows()
    got, want = answer(spark, rows, size), brute.repair(rows)
    assert got == want and None in got and sum(v[5] for v in got.values()) > 100


def test_no_conversations(spark):
    assert answer(spark, [], repair.BLOCK) == {}


def test_unrolled_runs_are_the_cheapest():
    symbols, counts = [4, 1, 1, 2, 8, 1, 5, 5, 5, 2, 3], [1, 1, 3, 1, 9, 1, 1, 1, 1, 1, 2]
    cost, audit, state, _, _ = repair.unroll(symbols, counts, repair.FINAL, 0, True)
    ahead = repair.FINAL
    for s, n in reversed(repair.runs(symbols, counts)):
        for _ in range(n):
            ahead = repair.after(repair.power(s, 0), ahead)
    assert cost == ahead[0] == repair.after(repair.transition(symbols, counts), repair.FINAL)[0]
    assert state in (0, 3) and len(audit.replace("I", "")) == sum(counts)
