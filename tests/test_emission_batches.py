"""Emissions, their windows and grids in Arrow batches; captures written by tasks; short and long recordings (round 3: F5, F6, F12, F13, F15)."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.functions import kernels as K
from motionloom.operators import live as LV
from motionloom.operators import resample as R
from motionloom.operators import windows as WN
from motionloom.plans import q_joins
from motionloom.sources import files as FS
from motionloom.sources import sinks as SK

AX = ["ax", "ay", "az", "gx", "gy", "gz"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def samples(spark, keys=3, rows=400):
    r = np.random.default_rng(5)
    data = [(k, i, i / 50.0, *r.normal(size=6).tolist()) for k in range(keys) for i in range(rows)]
    return spark.createDataFrame(data, "dev int, idx long, t double, " + ", ".join(f"{a} double" for a in AX))


def test_emissions_do_not_depend_on_blocks_or_batches(spark, monkeypatch):
    d = samples(spark)
    want = sorted(map(tuple, LV.causal_emissions(d, ["dev"], "t", 2.0, 0.7).collect()))
    assert want[:2] == [(0, 1.9), (0, 2.6)] and {w[0] for w in want} == {0, 1, 2}
    monkeypatch.setattr(LV, "STACK_ROWS", 50)
    assert sorted(map(tuple, LV.causal_emissions(d, ["dev"], "t", 2.0, 0.7, block_s=1.0).collect())) == want


def test_emission_windows_hold_every_sample_once(spark):
    d = samples(spark)
    e = LV.causal_emissions(d, ["dev"], "t", 2.0, 0.7)
    got = LV.emission_windows(d, e, ["dev"], "t", 2.0, ["ax"])
    rows = {(r["dev"], r["t"]): r["ax"] for r in d.collect()}
    for r in got.collect():
        want = sorted(t for k, t in rows if k == r["dev"] and r["now"] - 2.0 - 1e-9 <= t <= r["now"])
        assert r["t"] == want and r["ax"] == [rows[r["dev"], t] for t in want]
    assert got.count() == e.count()


def test_window_features_shuffle_no_exploded_rows(spark):
    d = samples(spark)
    e = d.select("dev", "t").filter("idx % 50 = 49 AND idx > 150")
    grid = LV.emission_grid(d, e, ["dev"], "idx", "t", AX, 3.0, 50.0)
    f = LV.window_features_v2(grid, ["dev"], dict(zip(WN.AXES, AX)), 50.0, 150)
    assert plan(f).count("Exchange hashpartitioning") == plan(grid).count("Exchange hashpartitioning")
    w = LV.emission_windows(d, e, ["dev"], "t", 2.0, AX)
    g = LV.window_features_live(w, ["dev"], "t", dict(zip(WN.AXES, AX)), 16)
    assert plan(g).count("Exchange hashpartitioning") == plan(w).count("Exchange hashpartitioning")
    assert f.count() == g.count() == e.count()


def test_grid_value_next_to_a_missing_one_is_missing(spark):
    d = samples(spark, 1).withColumn("ax", F.when(F.col("idx") != 100, F.col("ax")))
    e = spark.createDataFrame([(0, 199 / 50.0)], "dev int, t double")
    g = LV.grid_rows(LV.emission_grid(d, e, ["dev"], "idx", "t", ["ax", "ay"], 3.0, 50.0), ["ax", "ay"])
    rows = {r["k"]: r for r in g.collect()}
    first = 199 - 150 + 1  # sample of grid row 0
    assert len(rows) == 150 and [k + first for k, r in rows.items() if r["ax"] is None] == [99, 100]
    assert all(r["ay"] is not None for r in rows.values())


def test_gap_kernel_equals_v2_on_complete_windows():
    x = np.random.default_rng(2).normal(size=(5, 100, 6))
    a, b = K.v2(x, 50.0), K.v2_gaps(x, 50.0)
    for n in K.V2_NAMES:
        np.testing.assert_allclose(a[n], b[n], atol=1e-9, err_msg=n)


def test_captures_are_written_by_tasks_and_found_in_order(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("rec=rec"), (F.col("id") % 12).cast("string"), F.lit("/capture.csv")).alias("file"), F.col("id").cast("string").alias("line"))
    SK.write_small_files(rows, "file", "line", str(tmp_path / "out"))
    found = FS.discover_captures(spark, str(tmp_path / "out")).collect()
    assert [int(r["path"].split("rec=rec")[1].split("/")[0]) for r in found] == list(range(12))
    assert sorted(open(f"{tmp_path}/out/rec=rec3/capture.csv").read().split()) == ["15", "27", "3", "39", "51"]
    assert not glob.glob(f"{tmp_path}/out/*/*_part") and len(glob.glob(f"{tmp_path}/out/*/.*")) == 0


def test_short_and_long_recordings_have_equal_features(spark):
    d = samples(spark, 2, 700).withColumns({"roll": F.col("ax") * 9, "pitch": F.col("gy"), "yaw": F.col("gz")}).filter("dev = 0 OR idx < 300")
    axes = dict(zip([*WN.AXES, "angle_x", "angle_y", "angle_z"], [*AX, "roll", "pitch", "yaw"]))
    whole = WN.recording_contrast(d, ["dev"], "idx", axes)
    assert plan(whole).count("Exchange hashpartitioning(dev") == 1  # rows travel once
    a, b = (x.orderBy("dev").toPandas() for x in (whole, WN.recording_contrast(d, ["dev"], "idx", axes, size=400)))  # one short, one long
    assert a["dev"].tolist() == b["dev"].tolist() == [0, 1]
    for c in WN.CONTRAST:
        assert b[c].tolist() == pytest.approx(a[c].tolist(), abs=1e-9), c


def test_segment_windows_travel_before_they_are_copied(spark):
    d = samples(spark, 2, 300)
    s = spark.createDataFrame([(0, 1, 0.0, 5.5), (1, 1, 0.2, 4.0)], "device int, segment_id long, start_s double, end_s double")
    e = q_joins.segment_windows(d.withColumnRenamed("dev", "device"), s, 50.0, 100, 50)
    g = e.groupBy("device", "segment_id", "_wb", "win").count()
    assert plan(g).count("Exchange hashpartitioning") == plan(e).count("Exchange hashpartitioning")
    assert sorted((r["device"], r["win"]) for r in g.filter("count = 100").collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]


def test_resample_up_to_the_last_time_equals_its_duration(spark):
    d = samples(spark, 2, 77).withColumn("t", F.col("idx") / 37.0)
    last = d.groupBy("dev").agg(F.max("t").alias("end"))
    a = R.uniform_resample(d, ["dev"], "idx", "t", ["ax"], 50.0)
    b = R.uniform_resample(d.join(last, "dev"), ["dev"], "idx", "t", ["ax"], 50.0, "end")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
