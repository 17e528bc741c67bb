"""Captures of up to a block are fused whole after one shuffle, with the results of the blocks."""

import numpy as np
import pandas as pd

from motionloom.operators import live as LV


def frame(spark, rng, sizes):
    frames = []
    for dev, n in enumerate(sizes):
        a = rng.normal(size=(n, 3))
        a[rng.random(n) < 0.1] = 0
        p = pd.DataFrame({"dev": dev, "idx": range(n), "t": np.arange(n) * 0.02 + (np.arange(n) > 40) * 0.3, **dict(zip(("ax", "ay", "az"), a.T)), **dict(zip(("gx", "gy", "gz"), rng.normal(size=(3, n)) * 50))})
        p["calibrating"] = p["t"] <= (0.3 if dev % 4 else -1.0)  # every fourth has no calibration
        frames.append(p)
    d = pd.concat(frames).astype(object)
    for column in ("ax", "gx", "gz", "t", "calibrating"):
        d[column] = d[column].where(rng.random(len(d)) > 0.05, None)
    rows = [tuple(None if v is None or (isinstance(v, float) and np.isnan(v)) else v for v in r) for r in d.itertuples(index=False)]
    rows += [(None, i, i * 0.02, 0.0, 0.6, 0.8, 1.0, 2.0, 3.0, i < 5) for i in range(20)]
    return spark.createDataFrame(rows, "dev int, idx long, t double, ax double, ay double, az double, gx double, gy double, gz double, calibrating boolean")


def test_whole_captures_equal_blocks(spark, monkeypatch):
    monkeypatch.setattr(LV, "STACK_ROWS", 64)
    rng = np.random.default_rng(11)
    d = frame(spark, rng, [1, 2, 30, 90, 150, 64, 120, 77, 5]).cache()
    order = lambda x: x.toPandas().sort_values(["dev", "idx"]).reset_index(drop=True)
    got = order(LV.orientation_fusion(d, ["dev"], "idx", "t", "calibrating"))
    plain = LV._oriented(LV._long_fusion(d, ["dev"], "idx", "t", "calibrating", 1 << 17, 800), d.columns, "calibrating")
    want = order(plain)
    assert len(got) == d.count() and list(got.columns) == list(want.columns)
    for c in ("roll_deg", "pitch_deg", "yaw_deg", "q0", "q1", "q2", "q3"):
        assert (got[c].isna() == want[c].isna()).all(), c
        np.testing.assert_allclose(got[c], want[c], atol=1e-9, equal_nan=True)
    mixed = order(LV.orientation_fusion(d, ["dev"], "idx", "t", "calibrating", size=100))  # the longest in blocks
    np.testing.assert_allclose(mixed["q0"], want["q0"], atol=1e-9, equal_nan=True)
    d.unpersist()


def test_short_captures_take_one_shuffle(spark):
    rng = np.random.default_rng(12)
    d = frame(spark, rng, [50, 60]).filter("dev IS NOT NULL")
    plan = LV.orientation_fusion(d, ["dev"], "idx", "t", "calibrating")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan
