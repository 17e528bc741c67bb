"""Queries do the whole of the job that they are named after, on rows built here."""

import datetime as dt

from motionloom.plans import q_clean

LINEITEM = "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"


def captures(spark, path, devices, n, change=lambda device, i, row: row):
    """lineitem whose view imu6 has ``n`` rows a device, with every channel but gx (100) near rest; ``change`` edits a row."""
    start = dt.datetime(2000, 1, 1)
    rows = []
    for device in devices:
        for i in range(n):
            row = {"l_orderkey": 150, "l_linenumber": 4, "l_partkey": 300, "l_quantity": 30.0, "l_discount": 0.06, "l_tax": 0.04}
            row = change(device, i, row)
            rows.append((device, start + dt.timedelta(days=i), row["l_orderkey"], row["l_linenumber"], row["l_partkey"], row["l_quantity"], float(i), row["l_discount"], row["l_tax"]))
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{path}/lineitem.parquet")


def test_row_flags_look_at_all_six_channels(spark, tmp_path):
    wrong = {10: ("l_quantity", 25.0), 20: ("l_discount", 0.05), 30: ("l_tax", None), 40: ("l_partkey", 400), 50: ("l_orderkey", None), 60: ("l_linenumber", None)}

    def change(device, i, row):
        row["l_quantity"] += i % 2
        return row | {wrong[i][0]: wrong[i][1]} if device == 1 and i in wrong else row

    captures(spark, tmp_path, [1, 2], 80, change)
    got = {(r["device"], r["idx"]): (r["row_repaired"], r["row_anomaly"]) for r in q_clean.q_flags(spark, str(tmp_path)).collect()}
    assert len(got) == 160 and not any(anomaly for (device, _), (_, anomaly) in got.items() if device == 2)
    # a zero of ay is repaired, values missing from az, gy and gz and a gx of 200 (limit 199) are reported; ax has its zero
    assert [i for i in range(80) if got[1, i][0]] == [10, 20]
    assert [i for i in range(80) if got[1, i][1]] == [10, 20, 30, 40, 50, 60]


def test_row_flags_see_jumps_of_every_channel(spark, tmp_path):
    captures(spark, tmp_path, [1], 80, lambda device, i, row: row | {"l_linenumber": 5 + i % 2 if i < 70 else 7, "l_partkey": 300 + i * i % 7 + (60 if i >= 40 else 0)})
    got = {r["idx"]: r["row_anomaly"] for r in q_clean.q_flags(spark, str(tmp_path)).collect()}
    assert [i for i in range(80) if got[i]] == [40]  # only gx leaves its usual steps


SEGMENT = "device long, segment_id long, start_s double, end_s double, duration_s double, posture_state string, deviations array<string>, reference_source string, window_trainable boolean, evidence_tier string"


def test_posture_dataset_takes_segments_baselines_and_the_gate(spark):
    from pyspark.sql import functions as F

    from motionloom.plans import q_sources

    poses = {1: [(0.0, 1.0), (30.0, 1.0), (40.0, 50.0), (25.0, 1.0), (0.0, 1.0)], 2: [(0.0, 1.0)], 3: [(0.0, 1.0), (5.0, 1.0), (20.0, 1.0)]}
    rows = [(d, i, 0.0, 0.0, 1.0, motion, 0.0, 0.0, 0.0, 0.0, yaw) for d, held in poses.items() for s, (yaw, motion) in enumerate(held) for i in range(s * 200, s * 200 + 200)]
    samples = q_sources.with_quats(spark.createDataFrame(rows, "device long, idx long, ax double, ay double, az double, gx double, gy double, gz double, roll double, pitch double, yaw double")
                                   .withColumns({"segment_id": F.floor(F.col("idx") / 200), "t": F.col("idx") / 50.0}))
    turn = ("poor", ["head_turn_left"])
    labels = {1: [("normal", []), turn, turn, turn, ("poor", ["forward_head_candidate", "head_down"])], 2: [turn], 3: [("normal", []), turn, turn]}
    seg = spark.createDataFrame([(d, s, s * 4.0, s * 4.0 + 3.9, len(ls) * 4 - 0.02, state, dev, None, not (d == 3 and s == 2), "gold") for d, ls in labels.items() for s, (state, dev) in enumerate(ls)], SEGMENT)
    got = q_sources.posture_dataset(samples, seg).collect()
    windows = sorted((r["device"], r["segment_id"], int(r["win"]), r["window_start_s"], r["posture"], r["rotation_degrees_mean"]) for r in got if r["kind"] == "window")
    # seg 2 of device 1 moves, device 2 has no normal segment, device 3 turns by 5 degrees only; two windows of 3 s begin in 3.9 s
    want = [(1, s, w, s * 4 + w / 2, name, yaw) for s, name, yaw in ((0, "normal", 0.0), (1, "head_turn", 30.0), (3, "head_turn", 25.0)) for w in (0, 1)]
    assert windows == sorted(want + [(3, 0, w, w / 2, "normal", 0.0) for w in (0, 1)])
    manifest = {(r["device"], r["segment_id"]): (r["included"], r["excluded_reason"]) for r in got if r["kind"] == "manifest"}
    assert manifest == {k: (True, "") for k in [(1, 0), (1, 1), (1, 2), (1, 3), (3, 0), (3, 1)]} | {(2, 0): (False, "missing_normal_seated_baseline")}
    capped = q_sources.posture_dataset(samples.filter("device = 1"), seg.filter("device = 1").withColumn("end_s", F.col("start_s") + 4), cap=2).filter("kind = 'window' AND segment_id = 1")
    assert sorted(int(r["win"]) for r in capped.collect()) == [0, 2]  # of the starts 0, 1 and 2


def test_posture_query_gates_on_the_features_it_returns(spark, tmp_path):
    from motionloom.plans import q_sources

    captures(spark, tmp_path, [1, 2, 5, 7, 11, 22], 600, lambda device, i, row: row | {"l_partkey": 181 * 2 + i % 5, "l_orderkey": 361 * 3 + i % 7, "l_linenumber": 1 + i % 7})
    got = [r for r in q_sources.q_posture_dataset(spark, str(tmp_path)).collect()]
    windows = [r for r in got if r["kind"] == "window"]
    assert {r["posture"] for r in windows} > {"normal"} and {r["included"] for r in got if r["kind"] == "manifest"} == {True, False}
    assert all(r["gyro_mean_dps"] <= 12 and r["dynamic_acc_std_g"] <= 0.08 for r in windows)
    assert all(r["rotation_degrees_mean"] <= 12 if r["posture"] == "normal" else r["rotation_degrees_mean"] >= 15 for r in windows)


def test_captures_are_written_only_of_trials_that_pass(spark, tmp_path):
    from pyspark.sql import functions as F

    from motionloom.plans import q_sources

    axes = "ax double, ay double, az double, gx double, gy double, gz double"
    # 50 Hz configured, every second sample 4 ms late; 100 samples a device
    rows = [(d, i, i * 20000000 + i % 2 * 4000000, i, 50.0, 1.0, 0.0, float(i), 180.0, 0.0, 0.0) for d in (2, 3, 4, 5, 6, 7) for i in range(100)]
    s = spark.createDataFrame(rows, f"device long, idx long, ns long, seq long, rate double, {axes}")
    report = spark.createDataFrame([(d, ["sequence_gap"] if d == 7 else []) for d in (2, 3, 4, 5, 6, 7)], "device long, issues array<string>")
    trials = spark.createDataFrame([(1, "accepted", "gold"), (2, "recollect_required", "rejected"), (3, "accepted_with_note", "gold")], "trial long, status string, evidence_tier string")
    path = f"{tmp_path}/captures"
    got = sorted((r["trial"], r["device"], r["row_count"], r["duration_seconds"], r["last_sequence_id"]) for r in q_sources.accepted_captures(s, report, trials, path).collect())
    assert got == [(1, 2, 100, 1.98, 99), (1, 3, 100, 1.98, 99), (3, 6, 100, 1.98, 99)]
    stored = {r["sequence_id"]: r for r in spark.read.parquet(path).filter("device = 2").collect()}
    assert stored[1]["timestamp_monotonic_ns"] == 20000000 and abs(stored[1]["az"] - 9.80665 * 20 / 24) < 1e-9  # between samples 0 and 1, which came at 24 ms
    assert abs(stored[0]["ax"] - 9.80665) < 1e-9 and abs(stored[5]["gx"] - 3.141592653589793) < 1e-9


def test_the_audit_decides_what_captures_are_written(spark):
    from motionloom.plans import q_sources

    seen = {}
    real = q_sources.accepted_captures
    try:
        q_sources.accepted_captures = lambda s, report, trials, path: seen.update(trials=trials, report=report) or real(s, report, trials, path)
        got = {(r["trial"], r["device"]) for r in q_sources.q_captures(spark, "/root/testdata/sf0.001").collect()}
    finally:
        q_sources.accepted_captures = real
    status = {r["trial"]: r["status"] for r in seen["trials"].collect()}
    clean = {r["device"] for r in seen["report"].collect() if not r["issues"]}
    assert got == {(d // 2, d) for d in clean if status[d // 2] != "recollect_required"}
    assert set(status.values()) > {"recollect_required"} and got
