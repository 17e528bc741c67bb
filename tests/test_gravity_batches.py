"""The gravity filter takes many blocks at a time and keeps the plain recursion's directions."""

import numpy as np
import pandas as pd

from motionloom.operators import live as LV


def plain(u, g):
    out = []
    for v in u:
        g = 0.94 * g + 0.06 * v
        g = g / max(np.sqrt(g @ g), 1e-9)
        out.append(g)
    return np.array(out)


def test_filter_directions_follows_every_run():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(900, 3))
    starts, first = np.array([0, 3, 400, 401, 800]), rng.normal(size=(5, 3))
    want = np.concatenate([plain(u[a:z], f) for a, z, f in zip(starts, [*starts[1:], len(u)], first)])
    for few in (0, 2, 16):
        np.testing.assert_allclose(LV.filter_directions(u, starts, first.copy(), few), want, atol=1e-12)


def test_gravity_of_many_short_captures(spark, monkeypatch):
    monkeypatch.setattr(LV, "STACK_ROWS", 64)
    rng = np.random.default_rng(2)
    frames, want = [], {}
    for dev in range(40):
        n = int(rng.integers(1, 60))
        a = rng.normal(size=(n, 3))
        lead = int(rng.integers(0, 3)) if n > 3 else 0
        a[:lead] = 0
        frames.append(pd.DataFrame({"dev": dev, "idx": range(n), **dict(zip(("ax", "ay", "az"), a.T))}))
        up = np.array([0.0, 0.0, 1.0])
        u = a[lead:] / np.linalg.norm(a[lead:], axis=1)[:, None]
        want[dev] = np.concatenate([np.tile(up, (lead, 1)), plain(u, up if lead else u[0])])
    d = LV.gravity(spark.createDataFrame(pd.concat(frames)), ["dev"], "idx")
    assert "FlatMapGroupsInPandas" not in d._jdf.queryExecution().executedPlan().toString()  # not one Python call a capture
    got = d.toPandas().sort_values(["dev", "idx"])
    for dev, g in got.groupby("dev"):
        np.testing.assert_allclose(g[["g0", "g1", "g2"]], want[dev], atol=1e-9)


def test_rows_without_a_key_point_up(spark):
    d = spark.createDataFrame([(None, 0, 1.0, 0.0, 0.0), (None, 1, 0.0, 1.0, 0.0), (1, 0, 1.0, 0.0, 0.0)], "dev int, idx long, ax double, ay double, az double")
    got = {(r["dev"], r["idx"]): (r["g0"], r["g1"], r["g2"]) for r in LV.gravity(d, ["dev"], "idx").collect()}
    assert got == {(None, 0): (0.0, 0.0, 1.0), (None, 1): (0.0, 0.0, 1.0), (1, 0): (1.0, 0.0, 0.0)}
