"""Streaming forms equal their batch forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionloom.operators import episodes as EP
from motionloom.operators import live as LV
from motionloom.operators import packets as PK
from motionloom.streaming import sources as SS
from motionloom.streaming import stateful as ST


@pytest.fixture(autouse=True)
def rocksdb(spark):
    ST.use_rocksdb(spark)


def replay(spark, tmp_path, pdf, schema, build, parts=3, mode="append"):
    """Feed the rows as several files, one per micro-batch, and return what the stream wrote."""
    src = str(tmp_path / "in")
    cuts = np.linspace(0, len(pdf), parts + 1).astype(int)
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(pdf.iloc[a:b], schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "t_" + tmp_path.name.replace("-", "_")
    q = build(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name).toPandas()


def stream_rows(n=240):
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"dev": np.tile([1, 2], n // 2), "i": np.repeat(np.arange(n // 2), 2)})
    pdf["t"] = pdf["i"] * 0.5
    pdf["seq"] = (pdf["i"] * 3 + (pdf["i"] % 5 == 0) * 2) % 65536
    pdf["squat"] = np.where(pdf["i"] // 30 % 2 == 0, 0.9, 0.02)
    pdf["run"] = 0.05
    pdf["label"] = np.where(rng.random(len(pdf)) < 0.8, "a", "b")
    return pdf, "dev int, i int, t double, seq int, squat double, run double, label string"


def test_workout_stream(spark, tmp_path):
    pdf, schema = stream_rows()
    pdf["squat"] = np.where(pdf["i"] // 60 % 2 == 0, 0.9, 0.02)
    got = replay(spark, tmp_path, pdf, schema, lambda s: ST.workout(s, ["dev"], "t", ["squat", "run"], ["squat"]))
    batch = LV.workout_events(spark.createDataFrame(pdf, schema), ["dev"], "i", "t", ["squat", "run"], ["squat"]).toPandas()
    live = batch[batch["type"].isin(got["type"].unique())]
    # the stream has all events but those of the batch's last flush, in every column, for two devices that start together
    a = got.sort_values(["dev", "timestamp", "type"]).reset_index(drop=True)
    b = live.sort_values(["dev", "timestamp", "type"]).reset_index(drop=True)[a.columns.tolist()]
    flushed = b[b["timestamp"] > a["timestamp"].max()]
    assert len(a) == 6 and set(flushed["type"]) <= {"set_ended", "workout_ended"}
    b = b[b["timestamp"] <= a["timestamp"].max()].reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert a.groupby("dev")["session_id"].nunique().tolist() == [1, 1] and a["session_id"].nunique() == 2


def test_sequence_and_debounce_stream(spark, tmp_path):
    pdf, schema = stream_rows()
    d = spark.createDataFrame(pdf, schema)
    for name, build, batch, col in (
            ("seq", lambda s: ST.sequence_gaps(s, ["dev"], "i", "seq"), LV.sequence_gaps(d, ["dev"], "i", "seq"), "sequence_gaps"),
            ("deb", lambda s: ST.debounce(s, ["dev"], "i", "label"), EP.debounce_count(d, ["dev"], "i", "label"), "stable")):
        sub = tmp_path / name
        sub.mkdir()
        got = replay(spark, sub, pdf, schema, build).sort_values(["dev", "idx"])[col].tolist()
        assert got == batch.orderBy("dev", "i").toPandas()[col].tolist()


def test_normalise_and_windows_stream(spark, tmp_path):
    pdf = pd.DataFrame({"dev": 1, "i": range(900), "t": np.cumsum(np.random.default_rng(3).choice([0.005, 0.012], 900)), "v": np.arange(900.0)})
    schema = "dev int, i int, t double, v double"
    d = spark.createDataFrame(pdf, schema)
    (tmp_path / "n").mkdir(), (tmp_path / "w").mkdir()
    got = replay(spark, tmp_path / "n", pdf, schema, lambda s: ST.normalise(s, ["dev"], "t", "i", ["v"])).sort_values("t")
    want = LV.live_normalize(d, ["dev"], "i", "t", ["v"]).orderBy("t").toPandas()
    np.testing.assert_allclose(got["v"], want["v"], atol=1e-6)
    win = replay(spark, tmp_path / "w", pdf, schema, lambda s: ST.causal_windows(s, ["dev"], "t", 2.0, 1.0))
    assert sorted(win["now"]) == sorted(r["t"] for r in LV.causal_emissions(d, ["dev"], "t", 2.0, 1.0).collect())


def test_frames_and_clock_stream(spark, tmp_path):
    import struct

    data = b"".join(b"\x00" * (i % 3) + b"\x55\x61" + struct.pack("<9h", *range(i, i + 9)) for i in range(40))
    pdf = pd.DataFrame({"dev": 1, "i": range(0, (len(data) + 12) // 13)})
    pdf["p"] = [bytearray(data[k * 13:(k + 1) * 13]) for k in pdf["i"]]
    pdf["a"] = pdf["i"] * 0.01
    schema = "dev int, i int, p binary, a double"
    (tmp_path / "f").mkdir(), (tmp_path / "c").mkdir()
    got = replay(spark, tmp_path / "f", pdf, schema, lambda s: ST.frames(s, ["dev"], "i", "p"))
    d = spark.createDataFrame(pdf, schema)
    want = PK.decode_frames(d, ["dev"], "i", "a", "p", 7).toPandas().dropna(subset=["ax_g"]).sort_values(["block", "frame"])
    np.testing.assert_allclose(got.sort_values("ax_g")["gz_dps"], want.sort_values("ax_g")["gz_dps"])
    assert len(got) == 40
    clock = replay(spark, tmp_path / "c", pdf, schema, lambda s: ST.batch_clock(s.withColumn("n", F.col("i") % 4 + 1), ["dev"], "i", "n", "a")).sort_values("idx")
    b = LV.assign_batch_clock(d.withColumn("n", F.col("i") % 4 + 1), ["dev"], "i", "n", "a").orderBy("i").toPandas()
    np.testing.assert_allclose(clock["first_s"], b["first_s"], atol=1e-9)


def test_posture_and_calibration_stream(spark, tmp_path):
    pdf = pd.DataFrame({"dev": 1, "i": range(60), "t": np.arange(60) * 5.0, "label": ["poor"] * 20 + ["normal"] * 20 + [None] * 3 + ["poor"] * 17,
                        "g": np.where(np.arange(60) < 4, 20.0, 1.0), "command": [None] * 30 + ["calibrate"] + [None] * 29})
    schema = "dev int, i int, t double, label string, g double, command string"
    (tmp_path / "p").mkdir(), (tmp_path / "k").mkdir()
    got = replay(spark, tmp_path / "p", pdf, schema, lambda s: ST.posture_episodes(s, ["dev"], "t", "label")).sort_values("at")
    ep = EP.debounce_hold(spark.createDataFrame(pdf, schema), ["dev"], "i", "t", "label").orderBy("started_at").toPandas()
    assert got[got["type"] == "posture_started"]["at"].tolist() == ep["started_at"].tolist()
    cal = replay(spark, tmp_path / "k", pdf, schema, lambda s: ST.calibrate(s, ["dev"], "t", "g", "command")).sort_values("end")
    assert cal["ok"].tolist() == [False, True, True]


def test_event_store_is_idempotent(spark, tmp_path):
    pdf = pd.DataFrame({"id": ["a", "b", "a", "c", "b", "d"], "ts": pd.to_datetime(["2026-01-01"] * 6), "v": range(6)})
    schema = "id string, ts timestamp, v long"
    store = str(tmp_path / "store")
    src = str(tmp_path / "in")
    spark.createDataFrame(pdf, schema).repartition(3).write.parquet(src)
    for run in range(2):  # the second stream replays everything with a fresh checkpoint
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = ST.new_events(s, "id", "ts").writeStream.foreachBatch(ST.append_new(store, "id")).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    assert sorted(r["id"] for r in spark.read.parquet(store).collect()) == ["a", "b", "c", "d"]


def test_health_in_update_mode(spark, tmp_path):
    pdf = pd.DataFrame({"dev": [1, 2] * 30, "t": np.arange(60.0), "frames": 2, "discarded": 1})
    got = replay(spark, tmp_path, pdf, "dev int, t double, frames int, discarded int", lambda s: ST.health(s, "dev"), mode="complete")
    assert got.set_index("dev")["frames"].to_dict() == {1: 60, 2: 60}


def test_tail_source_follows_new_files(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).select(F.col("id"), (F.col("id") * 1.5).alias("v")).write.mode("append").option("header", True).csv(src)
        q = SS.tail_csv(spark, src, "id long, v double").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.read.parquet(out).count() == (k + 1) * 10
