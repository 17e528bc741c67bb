"""Captures of up to a block are resampled whole after one shuffle, with the results of the blocks."""

import numpy as np

from motionloom.operators import live as LV


def captures(spark, rng):
    rows = []
    for dev, n in enumerate([1, 2, 40, 3, 120, 75]):
        t = np.cumsum(rng.choice([0.008, 0.012, 0.03, 0.0, -0.01, 0.4], n, p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05])) + dev
        for i in range(n):
            x = rng.normal(size=2).tolist()
            rows.append((dev, i, None if rng.random() < 0.05 or (dev == 2 and i < 3) else float(t[i]), *(None if rng.random() < 0.1 else v for v in x)))
    rows += [(9, i, None, 1.0, 1.0) for i in range(4)] + [(None, i, i * 0.01, 1.0, 2.0) for i in range(30)]
    rows += [(10, i, float("nan") if i == 5 else i * 0.01, 1.0, float("nan") if i == 2 else 2.0) for i in range(9)]
    return spark.createDataFrame(rows, "dev int, idx long, at double, x double, y double")


def same(a, b):
    order = lambda d: d.toPandas().sort_values(["dev", "seg", "k"]).reset_index(drop=True)
    a, b = order(a), order(b)
    assert len(a) == len(b) > 100 and list(a.columns) == list(b.columns)
    for c in a.columns:
        assert (a[c].isna() == b[c].isna()).all(), c
        np.testing.assert_array_equal(a[c].to_numpy(float), b[c].to_numpy(float))


def test_whole_captures_equal_blocks(spark, monkeypatch):
    monkeypatch.setattr(LV, "STACK_ROWS", 64)
    d = captures(spark, np.random.default_rng(3)).cache()
    args = (["dev"], "idx", "at", ["x", "y"])
    want = LV.live_normalize(d, *args)
    same(LV.live_normalize(d, *args, whole=True), want)
    same(LV.live_normalize(d, *args, size=60, whole=True), want)  # the longest in blocks
    d.unpersist()


def test_short_captures_take_one_shuffle(spark):
    d = captures(spark, np.random.default_rng(4)).filter("dev < 9")
    plan = LV.live_normalize(d, ["dev"], "idx", "at", ["x", "y"], whole=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_live_exercise_score_takes_captures_whole(spark, monkeypatch):
    from motionloom.plans import q_live

    calls = []
    monkeypatch.setattr(LV, "_long_normalize", lambda *a: calls.append(a))
    assert q_live.q_live_exercise(spark, "/root/testdata/sf0.001").count() > 0 and not calls
