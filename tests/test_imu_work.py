"""The sensor view and the steps on it do their work once, with the results of the plain rule."""

import datetime as dt
import random
from statistics import median

import numpy as np
import pyarrow as pa
import pytest

from motionloom.operators import packets as PK
from motionloom.operators import posture as P
from motionloom.plans.views import IMU_ORDER, imu6


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imu_numbers_rows_through_quarters(spark, tmp_path):
    rng = random.Random(5)
    days = [dt.datetime(1999, 1, 1) + dt.timedelta(days=k) for k in range(0, 800, 40)] + [None]
    rows = [(rng.choice([1, 2, None]), rng.choice(days), i, i % 3, 1, 5.0, float(i), 0.05, 0.02) for i in range(300)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = imu6(spark, str(tmp_path))
    assert "date_trunc" in plan(got) or "trunctimestamp" in plan(got)  # not one block a day
    assert IMU_ORDER[0] == "l_shipdate"
    found = {(r["device"], r["idx"]): r["gy"] for r in got.filter("device IS NOT NULL").collect()}
    for device in (1, 2):
        mine = sorted((r for r in rows if r[0] == device), key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[2]))
        assert [found[device, i] for i in range(len(mine))] == [float(r[2] % 301 - 150) for r in mine]


def test_neutral_baseline_takes_its_medians_in_one_pass(spark, monkeypatch):
    calls = []
    real = P.exact_percentile
    monkeypatch.setattr(P, "exact_percentile", lambda *a, **k: calls.append(a) or real(*a, **k))
    rows = [(1, 1.0, 0.0, 3.0, 10.0), (1, 3.0, None, 1.0, 20.0), (1, 2.0, 4.0, 8.0, 30.0), (2, 1.0, None, 1.0, 0.0), (None, 1.0, 1.0, 1.0, 0.0)]
    d = spark.createDataFrame(rows, "d int, ax double, ay double, az double, roll double")
    got = P.neutral_baseline(d, ["d"], ["ax", "ay", "az"], ["roll"]).collect()
    assert len(calls) == 1 and [r["d"] for r in got] == [1]  # a device without values of an axis has no baseline
    m = np.array([median([1, 3, 2]), 2.0, 3.0])
    assert [got[0][f"base_{a}"] for a in ("ax", "ay", "az")] == pytest.approx((m / np.linalg.norm(m)).tolist())


def compact(samples, magic=b"IM", damage=0):
    body = magic + bytes([1, len(samples)]) + b"".join(np.array(s, "<i2").tobytes() for s in samples)
    crc = int(PK.crc16(np.frombuffer(body, np.uint8)[None])[0]) ^ damage
    return body + crc.to_bytes(2, "little")


def test_compact_packets_of_mixed_lengths(spark):
    two, one = [[65535 - 65536, 1, 2, 3, 4, 5, -6], [0, 32767, -32768, 0, 0, 0, 16]], [[7, 16, 0, 0, 0, 0, 0]]
    rows = [(0, compact(two)), (1, None), (2, compact(one, b"IN")), (3, compact(one, damage=1)), (4, compact([])), (5, compact(one) + b"\0"), (6, b"IM"), (7, compact(one)), (8, b"")]
    d = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in rows], "i int, payload binary").coalesce(1)
    got = {r["i"]: (r["reason"], r["samples"]) for r in PK.decode_compact(d, "payload").collect()}
    assert [got[i][0] for i in range(9)] == [None, "too_short", "unsupported_packet", "crc_failed", None, "length_mismatch", "too_short", None, "too_short"]
    assert [got[i][1] is None for i in range(9)] == [False, True, True, True, False, True, True, False, True]
    scale = lambda s: [s[0] & 0xFFFF, *[v * k / 32768 for v, k in zip(s[1:], [16.0] * 3 + [2000.0] * 3)]]
    assert [[list(s) for s in got[i][1]] for i in (0, 4, 7)] == [[scale(s) for s in two], [], [scale(s) for s in one]]
    crc = {r["i"]: r["c"] for r in d.select("i", PK.crc_of(d.payload).alias("c")).collect()}
    assert crc[1] is None and crc[8] == 0xFFFF and crc[6] == int(PK.crc16(np.frombuffer(b"IM", np.uint8)[None])[0])


def test_packets_are_grouped_by_length():
    got = {rows.shape[1]: at.tolist() for at, rows in PK.same_lengths(pa.array([b"ab", None, b"c", b"de"], pa.binary()))}
    assert got == {0: [1], 1: [2], 2: [0, 3]}


def test_session_audit_computes_its_streams_once(spark, monkeypatch):
    from motionloom.plans import q_labels

    kept = []
    monkeypatch.setattr(q_labels, "staged", lambda df, name="stage": kept.append(name) or df)
    q_labels.trial_reports(spark, "/root/testdata/sf0.001")
    assert kept == ["streams"]


def test_frames_query_keeps_only_its_columns(spark, monkeypatch):
    from motionloom.plans import q_live

    kept = {}
    real = q_live.staged
    monkeypatch.setattr(q_live, "staged", lambda df, name="stage": kept.update({name: df.columns}) or real(df, name))
    q_live.q_frames(spark, "/root/testdata/sf0.001")
    assert kept["frames"] == ["device", "arrival", "ax_g", "gx_dps", "yaw_deg", "discarded"]
