"""Hand-known answers on small inputs, and brute force where there is no SQL twin."""

import math
import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionloom.functions import scalar as S
from motionloom.functions import taxonomy as T
from motionloom.functions.spectral import partial_dft
from motionloom.operators import episodes as EP
from motionloom.operators import evaluate as E
from motionloom.operators import live as LV
from motionloom.operators import machines as MC
from motionloom.operators import workout as WK
from motionloom.operators import packets as PK
from motionloom.operators import posture as P
from motionloom.operators import resample as R
from motionloom.operators import timeaxis as ta
from motionloom.operators import windows as WN

MAP = dict(zip(WN.AXES, ["ax", "ay", "az", "gx", "gy", "gz"]))


def sine(spark, n=200, hz=1.5):
    t = np.arange(n) / 50
    return spark.createDataFrame(pd.DataFrame({"dev": 1, "idx": range(n), "t": t, "ax": 0.2 * np.sin(2 * np.pi * hz * t), "ay": 0.0, "az": 1.0,
                                               "gx": 20 * np.sin(2 * np.pi * hz * t), "gy": 0.0, "gz": 0.0}))


def test_sine_window(spark):
    r = WN.window_stats_v2(sine(spark), ["dev"], "idx", MAP).collect()
    assert len(r) == 1
    assert r[0]["gyro_x_dominant_hz"] == pytest.approx(1.5) and r[0]["gravity_z"] > 0.98
    assert r[0]["gyro_x_period_s"] == pytest.approx(2 / 3, abs=0.02)
    assert len([c for c in r[0].asDict() if c not in ("dev", "win")]) == 91


def test_windows_do_not_depend_on_blocks(spark):
    d = sine(spark, 1000)
    big = WN.window_stats_v2(d, ["dev"], "idx", MAP).orderBy("win").toPandas()
    small = WN.window_stats_v2(d, ["dev"], "idx", MAP, size=70).orderBy("win").toPandas()
    assert len(big) == 17
    pd.testing.assert_frame_equal(big, small[big.columns], check_exact=False, atol=1e-9)


def test_partial_dft_sums_to_fft():
    x = np.random.default_rng(0).normal(size=601)
    parts = sum(partial_dft(x[a:a + 100], a, 601, 5, 40) for a in range(0, 601, 100))
    np.testing.assert_allclose(parts, np.fft.fft(x)[5:45], atol=1e-8)


def test_recording_contrast_small_blocks(spark):
    d = sine(spark, 900).withColumns({"roll": F.col("ax"), "pitch": F.col("ax"), "yaw": F.col("gx")})
    m = {**MAP, "angle_x": "roll", "angle_y": "pitch", "angle_z": "yaw"}
    r = WN.recording_contrast(d, ["dev"], "idx", m, size=128, bins=8).collect()[0]
    assert r["gyro_dominant_hz"] == pytest.approx(3.0, abs=0.06)  # magnitude of a sine has twice its frequency
    assert r["n"] == 900


def test_resample_ramp_has_101_rows(spark):
    d = spark.range(101).select(F.lit(1).alias("dev"), F.col("id").alias("idx"), (F.col("id") * 0.02).alias("t"), (F.col("id") / 100).alias("v"), F.lit(2.0).alias("dur"))
    g = R.uniform_resample(d, ["dev"], "idx", "t", ["v"], 50.0, "dur", size=16).orderBy("grid_t").collect()
    assert len(g) == 101 and g[-1]["v"] == pytest.approx(1.0)


def test_interpolation_at_irregular_times(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.03, 10.0), (1, 0.04, 10.0)], "dev int, t double, v double")
    q = spark.createDataFrame([(1, 0.02, 0), (1, -1.0, 1), (1, 9.0, 2)], "dev int, t double, i int")
    got = {r["i"]: r["v"] for r in R.grid_interpolate(s, q, ["dev"], "t", "v", F.floor(F.col("t") / 0.025), "i").collect()}
    assert got[0] == pytest.approx(20 / 3) and got[1] == 0.0 and got[2] == 10.0


def test_resample_ns(spark):
    d = spark.createDataFrame([(1, i, 5 + i * 30_000_000, float(i)) for i in range(5)], "dev int, idx int, ns long, v double")
    g = R.resample_ns(d, ["dev"], "idx", "ns", ["v"], F.lit(50.0), size=2).orderBy("sequence_id").collect()
    assert [r["ns"] - 5 for r in g] == [i * 20_000_000 for i in range(7)]
    np.testing.assert_allclose([r["v"] for r in g], np.interp(np.arange(7) * 20, np.arange(5) * 30, np.arange(5)), atol=1e-12)


def test_bucket_is_half_even(spark):
    d = spark.createDataFrame([(10,), (30,), (50,)], "s int").select(ta.capture_bucket(F.timestamp_seconds("s"), F.lit("a")).alias("b"))
    assert [r["b"][-6:] for r in d.collect()] == ["000000", "000040", "000040"]


def test_angle_wrap(spark):
    d = spark.createDataFrame([(179.0,), (-179.0,), (-175.0,)], "v double").select(S.angle_wrap_diff(F.col("v"), F.lit(178.0)).alias("d"))
    assert [r["d"] for r in d.collect()] == [1.0, 3.0, 7.0]


def posture_input(spark, roll, pitch, yaw, acc, n=150):
    d = spark.range(n).select(F.lit(1).alias("dev"), F.col("id").alias("idx"), *[F.lit(float(v)).alias(c) for c, v in zip(("ax", "ay", "az"), acc)],
                              *[F.lit(0.0).alias(c) for c in ("gx", "gy", "gz")], F.lit(float(roll)).alias("roll"), F.lit(float(pitch)).alias("pitch"), F.lit(float(yaw)).alias("yaw"))
    return d.withColumns({f"q{i}": e for i, e in enumerate(S.quat_from_euler(F.col("roll"), F.col("pitch"), F.col("yaw")))})


def test_posture_window(spark):
    d = posture_input(spark, 30, 0, 0, (1, 0, 0))
    base = {"ax": F.lit(0.0), "ay": F.lit(0.0), "az": F.lit(1.0), "roll": F.lit(15.0), "pitch": F.lit(25.0), "yaw": F.lit(-20.0), "q0": F.lit(1.0), "q1": F.lit(0.0), "q2": F.lit(0.0), "q3": F.lit(0.0)}
    r = P.posture_windows(d, ["dev"], "idx", base).collect()[0]
    assert (r["relative_roll_mean"], r["relative_pitch_mean"], r["relative_yaw_mean"]) == (15.0, -25.0, 20.0)
    assert r["gravity_change_degrees"] == pytest.approx(90.0) and r["rotation_vector_x_mean"] == pytest.approx(30.0)


def test_posture_window_rejects_missing(spark):
    d = posture_input(spark, 0, 0, 0, (0, 0, 1)).withColumn("gx", F.when(F.col("idx") != 70, F.col("gx")))
    base = {c: F.lit(0.0) for c in ("ax", "ay", "roll", "pitch", "yaw", "q1", "q2", "q3")} | {"az": F.lit(1.0), "q0": F.lit(1.0)}
    assert P.posture_windows(d, ["dev"], "idx", base).count() == 0


def test_mean_quaternion(spark):
    b = P.neutral_baseline(posture_input(spark, 20, 10, 5, (0, 0, 2)), ["dev"], ["ax", "ay", "az"], ["roll", "pitch", "yaw"], ["q0", "q1", "q2", "q3"]).collect()[0]
    q = posture_input(spark, 20, 10, 5, (0, 0, 2), 1).select("q0", "q1", "q2", "q3").first()
    np.testing.assert_allclose(b["base_quat"], list(q), atol=1e-9)
    assert b["base_az"] == pytest.approx(1.0) and b["base_roll"] == pytest.approx(20.0)


def test_hold_episode(spark):
    d = spark.createDataFrame([(1, 0, 0.0, "poor"), (1, 1, 30.0, "poor"), (1, 2, 40.0, "normal"), (1, 3, 45.0, "normal")], "dev int, idx int, t double, l string")
    r = EP.debounce_hold(d, ["dev"], "idx", "t", "l").collect()
    assert [(x["started_at"], x["ended_at"], x["duration_s"]) for x in r] == [(0.0, 40.0, 40.0)]


def test_hold_equals_machine_with_unsure_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, i * 6.0, [None, "poor", "normal", "poor", "normal", "poor"][int(rng.integers(0, 6) if rng.random() < 0.3 else (i // 9) % 2 + 1)]) for i in range(600)]
    d = spark.createDataFrame(rows, "dev int, idx int, t double, l string")
    got = sorted((r["started_at"], r["ended_at"]) for r in EP.debounce_hold(d, ["dev"], "idx", "t", "l", size=17).collect())
    s, want, start = {}, [], None
    for _, _, t, l in rows:
        for e in MC.hold_step(s, t, l):
            if e["type"] == "posture_started":
                start = e["at"]
            else:
                want.append((start, e["at"]))
                start = None
    want += [(start, None)] if start is not None else []
    assert got == want and len(want) > 3


def workout_rows(spark, phases, step=0.5):
    rows, t, i = [], 0.0, 0
    for seconds, squat, run in phases:
        for _ in range(int(seconds / step)):
            rows.append((1, i, t, squat, run))
            t, i = t + step, i + 1
    return spark.createDataFrame(rows, "dev int, idx int, t double, squat double, run double"), rows


def test_two_squat_sets(spark):
    d, _ = workout_rows(spark, [(12.5, 0.9, 0.0), (20.5, 0.05, 0.0), (13, 0.9, 0.0), (30, 0.05, 0.0)])
    ev = LV.workout_events(d, ["dev"], "idx", "t", ["squat", "run"], ["squat"]).toPandas()
    end = ev[ev["type"] == "workout_ended"].iloc[0]
    assert end["sets"] == 2 and (ev["type"] == "workout_started").sum() == 1
    assert end["duration_seconds"] == pytest.approx(25.5, abs=1.0)


def test_start_holds(spark):
    d, _ = workout_rows(spark, [(40, 0.3, 0.5)], 1.0)
    ev = LV.workout_events(d, ["dev"], "idx", "t", ["squat", "run"], ["squat"]).toPandas()
    assert "cardio_started" in set(ev["type"])
    policy = WK.Workout(["squat"], ["squat"])
    hits = [t for t in range(40) if policy.advance(np.array([float(t)]), np.array([[0.9]]), np.array([False]))]
    assert hits == [3]


def stretches(t, p, poor, cuts):
    """Events of the rows cut into stretches, the state carried as JSON."""
    state, out = None, []
    for a, b in zip(cuts, cuts[1:]):
        policy = WK.Workout(["squat", "run"], ["squat"], "1", json.loads(json.dumps(state)) if state else None)
        out += policy.advance(t[a:b], p[a:b], poor[a:b])
        state = policy.state
    return out + policy.flush(float(t[-1]))


def test_workout_session_by_hand():
    # 0-9 s squats, rest, 40-51 s squats of which two rows are poor, rest; one row a second
    t = np.arange(400.0)
    squat = np.where((t < 10) | ((t >= 40) & (t < 52)), 0.9, 0.1)
    poor = (t == 43) | (t == 44)
    p = np.stack([squat, np.full(400, 0.05)], 1)
    events = stretches(t, p, poor, [0, 400])
    brief = [(e[0], e[2], e[6], e[8]) for e in events]
    assert brief == [("workout_started", 0.0, None, None), ("set_started", 0.0, None, None), ("set_ended", 10.0, 10.0, None), ("set_started", 45.0, None, None),
                     ("set_ended", 52.0, 7.0, None), ("workout_ended", 292.0, 17.0, 2)]
    assert len({e[1] for e in events}) == 1


def test_workout_does_not_depend_on_cuts():
    rng = np.random.default_rng(5)
    n = 3000
    t, level = np.cumsum(rng.choice([0.5, 1.0, 9.0], n)), np.array([[0.9, 0.02], [0.05, 0.8], [0.1, 0.05], [0.3, 0.4]])
    p = np.clip(level[np.repeat(rng.integers(0, 4, n), rng.integers(1, 60, n))[:n]] + rng.normal(0, 0.08, (n, 2)), 0, 1)
    poor = rng.random(n) < 0.03
    want = stretches(t, p, poor, [0, n])
    assert len(want) > 20
    for cuts in ([*range(0, n, 7), n], sorted({0, n, *rng.integers(0, n, 20).tolist()})):
        got = stretches(t, p, poor, cuts)
        assert [e[:4] for e in got] == [e[:4] for e in want]
        assert [e[7] for e in got if e[7] is not None] == pytest.approx([e[7] for e in want if e[7] is not None])


def test_quiet_cut_equals_one_long_run(spark):
    rng = np.random.default_rng(8)
    phases = []
    for _ in range(12):
        phases += [(float(rng.integers(3, 60)), *((0.9, 0.02) if rng.random() < 0.5 else (0.05, 0.8))), (float(rng.choice([10, 25, 300, 900])), 0.1, 0.05)]
    d, rows = workout_rows(spark, phases, 1.0)
    got = LV.workout_events(d, ["dev"], "idx", "t", ["squat", "run"], ["squat"], size=50).toPandas().sort_values(["timestamp", "type"])
    flat = np.array([r[2:] for r in rows])
    want = pd.DataFrame(stretches(flat[:, 0], flat[:, 1:], np.zeros(len(flat), bool), [0, len(flat)]), columns=WK.WORKOUT_EVENT).sort_values(["timestamp", "type"])
    assert list(got["type"]) == list(want["type"]) and list(got["session_id"]) == list(want["session_id"])
    np.testing.assert_allclose(got["timestamp"], want["timestamp"])
    cut = LV.quiet_episodes(d, ["dev"], "idx", "t", F.col("squat") + F.col("run"), 50)
    assert cut.select("episode").distinct().count() > 3 and cut.count() < len(rows)


def frame(v):
    return MC.FRAME_MAGIC + struct.pack("<9h", *v)


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_frames_over_chunks_and_noise(spark, chunk_rows):
    rng = np.random.default_rng(2)
    data, values = b"", []
    for i in range(60):
        if rng.random() < 0.3:
            data += bytes(rng.integers(0, 80, int(rng.integers(1, 9))).tolist())
        v = rng.integers(-32768, 32767, 9).tolist()
        values.append(v)
        data += frame(v)
    cuts = sorted({0, len(data), *rng.integers(1, len(data), 90).tolist()})
    rows = [(1, i, float(i), bytearray(data[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = PK.decode_frames(spark.createDataFrame(rows, "dev int, idx int, a double, p binary"), ["dev"], "idx", "a", "p", chunk_rows).toPandas()
    s, want = {}, []
    for _, _, _, p in rows:
        want += MC.frame_step(s, bytes(p))
    have = got.dropna(subset=["ax_g"]).sort_values(["block", "frame"])
    np.testing.assert_allclose(have[PK.AXIS_NAMES].to_numpy(), np.array(want))
    assert got["discarded"].sum() == s["lost"]
    assert len(want) >= 55


def test_two_frames_of_one_g(spark):
    one = frame([2048] + [0] * 8)
    data = b"\x01\x55\x02" + one + one
    rows = [(1, 0, 0.0, bytearray(data[:9])), (1, 1, 1.0, bytearray(data[9:30])), (1, 2, 2.0, bytearray(data[30:]))]
    got = PK.decode_frames(spark.createDataFrame(rows, "dev int, idx int, a double, p binary"), ["dev"], "idx", "a", "p").toPandas()
    assert list(got["ax_g"]) == [1.0, 1.0] and got["discarded"].sum() == 3


def test_crc_known_value():
    assert PK.crc16(np.frombuffer(b"123456789", np.uint8)[None, :])[0] == 0x29B1


def test_clock_is_increasing():
    count = np.array([1.0, 1.0, 8.0])
    first, period = WK.clock({}, count, np.array([10.0, 10.00125, 10.01125]))
    out = [f + k * p for f, p, n in zip(first, period, count) for k in range(int(n))]
    assert all(b > a for a, b in zip(out, out[1:])) and 1 / period[-1] > 500


def test_clock_closed_form_equals_machine(spark):
    rng = np.random.default_rng(6)
    n, a = rng.integers(1, 9, 300), np.cumsum(rng.choice([0.0, 0.004, 0.02, 0.3], 300))
    rows = [(1, i, int(x), float(y)) for i, (x, y) in enumerate(zip(n, a))]
    got = LV.assign_batch_clock(spark.createDataFrame(rows, "dev int, idx int, n int, a double"), ["dev"], "idx", "n", "a", size=31).orderBy("idx").toPandas()
    state, parts = {}, []
    for k in range(0, 300, 23):
        parts.append(np.stack(WK.clock(state, n[k:k + 23].astype(float), a[k:k + 23]), 1))
    want = np.concatenate(parts)
    # by hand: each notification ends at its arrival or right after the one before
    last = None
    for (_, _, x, y), (first, period) in zip(rows, want):
        ask = y if last is None else max(y - period * (x - 1), last + 1e-6)
        assert first == pytest.approx(ask, abs=1e-9)
        last = ask + period * (x - 1)
    np.testing.assert_allclose(got[["first_s", "period_s"]], want, atol=1e-9)


def test_normalise_801_samples(spark):
    rows = [(1, i, i / 800, float(i)) for i in range(801)]
    got = LV.live_normalize(spark.createDataFrame(rows, "dev int, idx int, t double, v double"), ["dev"], "idx", "t", ["v"], size=64).orderBy("t").toPandas()
    assert 99 <= len(got) <= 102
    state, want = {}, []
    for k in range(0, 801, 50):
        want += WK.normalise(state, np.array([r[2] for r in rows[k:k + 50]]), np.array([[r[3]] for r in rows[k:k + 50]]))[1][:, 0].tolist()
    np.testing.assert_allclose(got["v"], want, atol=1e-6)
    grid = np.arange(len(want)) * 8.0  # the values at 100 Hz, then the mean of up to 7
    np.testing.assert_allclose(want, [grid[max(0, i - 6):i + 1].mean() for i in range(len(grid))], atol=1e-6)


def test_greedy_chain_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    ts = np.unique(rng.random(900).round(4) * 60)
    d = spark.createDataFrame([(1, float(t), float(t) + 1.0) for t in ts], "dev int, t double, until double")
    got = sorted(r["t"] for r in LV.greedy_chain(d, ["dev"], "t", "until", F.lit(-1e300), block_s=2.5).collect())
    want, last = [], -math.inf
    for t in ts:
        if t - last >= 1.0 - 1e-9:
            want.append(float(t))
            last = t
    assert got == want


def test_causal_emissions_equal_machine(spark):
    rng = np.random.default_rng(11)
    t = np.cumsum(rng.choice([0.02, 0.021, 0.05], 3000))
    t[1500:] += 7.0  # a stall
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(t)], "dev int, idx int, t double")
    got = sorted(r["t"] for r in LV.causal_emissions(d, ["dev"], "t", 4.0, 1.0).collect())
    s, want = {}, []
    for x in t:
        e = MC.window_step(s, float(x))
        want += [e["now"]] if e else []
    assert got == want and len(want) > 50


def fusion_reference(rows, cal):
    g = base = last = None
    bias, yaw, seen, out = np.zeros(3), 0.0, [], []
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    for i, (t, a, w) in enumerate(rows):
        d = unit(np.array(a))
        before, g = g, unit(d if g is None else 0.94 * g + 0.06 * d)
        if cal[i]:
            seen.append(w)
            out.append((0.0, 0.0, 0.0))
            last = t
            continue
        if base is None:
            base, bias, last = unit(before), np.median(np.array(seen), axis=0), None
        dt = 0.0 if last is None else min(max(t - last, 0.0), 0.1)
        yaw += np.deg2rad(np.dot(np.array(w) - bias, g)) * dt
        last = t
        tilt = np.array([1 + base @ g, *np.cross(base, g)])
        tilt /= np.linalg.norm(tilt)
        y = np.array([np.cos(yaw / 2), *(base * np.sin(yaw / 2))])
        w1, x1, y1, z1 = y
        w2, x2, y2, z2 = tilt
        q = np.array([w1*w2-x1*x2-y1*y2-z1*z2, w1*x2+x1*w2+y1*z2-z1*y2, w1*y2-x1*z2+y1*w2+z1*x2, w1*z2+x1*y2-y1*x2+z1*w2])
        w0, x0, y0, z0 = q / np.linalg.norm(q)
        out.append(tuple(np.rad2deg([np.arctan2(2*(w0*x0+y0*z0), 1-2*(x0*x0+y0*y0)), np.arcsin(np.clip(2*(w0*y0-z0*x0), -1, 1)), np.arctan2(2*(w0*z0+x0*y0), 1-2*(y0*y0+z0*z0))])))
    return np.array(out)


def test_orientation_fusion_small_blocks(spark):
    rng = np.random.default_rng(12)
    n = 3000
    tilt = np.where(np.arange(n) < 100, 0.0, np.sin(np.arange(n) / 80) * 0.6)
    a = np.stack([np.sin(tilt), 0.1 + rng.normal(scale=0.02, size=n), np.cos(tilt)], axis=1)
    w = rng.normal(scale=20, size=(n, 3)) + 1.5
    t = np.arange(n) * 0.02
    cal = t < 1.0
    pdf = pd.DataFrame({"dev": 1, "idx": range(n), "t": t, "calibrating": cal, **{c: v for c, v in zip(("ax", "ay", "az", "gx", "gy", "gz"), np.hstack([a, w]).T)}})
    got = LV.orientation_fusion(spark.createDataFrame(pdf), ["dev"], "idx", "t", "calibrating", size=500).orderBy("idx").toPandas()
    want = fusion_reference(list(zip(t, a, w)), cal)
    np.testing.assert_allclose(got[["roll_deg", "pitch_deg", "yaw_deg"]], want, atol=1e-6)
    assert np.abs(want[-200:, :2]).max() > 10


def test_unusable_acceleration_keeps_gravity(spark):
    n = 3000
    rng = np.random.default_rng(13)
    a = np.stack([np.full(n, 0.5), rng.normal(0, 0.1, n), np.full(n, 0.8)], 1)
    for lo, hi in ((0, 7), (400, 2400)):  # a lead-in and 2,000 rows in a row without acceleration
        a[lo:hi] = 0
    pdf = pd.DataFrame({"dev": 1, "idx": range(n), **dict(zip(("ax", "ay", "az"), a.T))})
    got = LV.gravity(spark.createDataFrame(pdf), ["dev"], "idx", size=500).orderBy("idx").toPandas()
    g, want = None, []
    for v in a:
        length = np.linalg.norm(v)
        if length > 1e-6:
            g = v / length if g is None else 0.94 * g + 0.06 * v / length
            g = g / np.linalg.norm(g)
        elif g is None:
            g = np.array([0.0, 0.0, 1.0])
        want.append(g)
    np.testing.assert_allclose(got[["g0", "g1", "g2"]], want, atol=1e-12)


@pytest.mark.parametrize("chunk", [15.0, 600.0])
def test_calibration_attempts(spark, chunk):
    rng = np.random.default_rng(14)
    devices = {1: (np.arange(0, 90, 0.1), lambda t: np.where(t < 31, 20.0, 1.0)), 2: (np.arange(0, 4000, 0.5), lambda t: np.full(len(t), 50.0)),
               3: (np.cumsum(rng.choice([0.2, 0.9, 45.0], 400)), lambda t: np.where(t < 700, 20.0, 2.0)), 4: (np.array([0.0, 1.0]), lambda t: t)}
    frames = [pd.DataFrame({"dev": k, "t": t.round(3), "g": f(t)}) for k, (t, f) in devices.items()]
    got = {r["dev"]: r for r in LV.posture_calibrate(spark.createDataFrame(pd.concat(frames)), ["dev"], "t", F.col("g"), chunk_s=chunk).collect()}
    for k, d in enumerate(frames, 1):
        t, g, i, tries, hit = d["t"].to_numpy(), d["g"].to_numpy(), 0, 0, None
        while i < len(t) and hit is None:
            j = int(np.searchsorted(t, t[i] + 10.0 - 1e-9))
            if j >= len(t):
                break
            tries += 1
            if g[i:j + 1].mean() <= 8.0:
                hit = (t[i], t[j], g[i:j + 1].mean())
            i = j + 1
        assert got[k]["ok"] == (hit is not None) and got[k]["attempts"] == tries
        if hit:
            assert (got[k]["start"], got[k]["end"], got[k]["mean_gyro"]) == pytest.approx(hit)


@pytest.mark.parametrize("chunk_rows", [4, 30, 1000])
def test_frames_in_single_bytes_with_empty_chunks(spark, chunk_rows):
    data = b"".join(frame([i] * 9) for i in range(20))
    rows = []
    for b in data:
        rows += [(1, len(rows), 0.0, bytearray([b])), (1, len(rows) + 1, 0.0, bytearray())]
    got = PK.decode_frames(spark.createDataFrame(rows, "dev int, idx int, a double, p binary"), ["dev"], "idx", "a", "p", chunk_rows).dropna(subset=["ax_g"])
    assert got.count() == 20


def test_impossible_holdout_raises(spark):
    from motionloom.operators import evaluate as EV

    d = spark.createDataFrame([(s, s) for s in range(6)], "subject int, label int")
    for f in (lambda: EV.subject_holdout(d, "subject", "label", 0.2, 50), lambda: EV.three_way_split(d, "subject", "label", 50), lambda: EV.class_cover_split(d, "subject", "label", 50)):
        with pytest.raises(Exception, match="no candidate"):
            f().collect()


def test_large_note_is_read(spark, tmp_path):
    from motionloom.sources import files as FS

    (tmp_path / "a.txt").write_text("x" * 300_000, encoding="utf8")
    assert FS.scan_notes(spark, str(tmp_path)).select(F.length("content")).first()[0] == 300_000
    row = FS.scan_notes(spark, str(tmp_path), limit=100_000).first()
    assert row["content"] is None and row["reason"] == "too_large"


def test_lcs_equals_plain_table(spark):
    from motionloom.functions import scalar as S

    rng = np.random.default_rng(15)
    pairs = [([str(x) for x in rng.integers(0, 4, rng.integers(0, 30))], [str(x) for x in rng.integers(0, 4, rng.integers(0, 30))]) for _ in range(60)]
    pairs += [([], ["a"]), (["a", None, "b"], ["a", None, "b"]), (None, ["a"])]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>").repartition(4)
    got = {r["i"]: r["n"] for r in d.select("i", S.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    for i, (a, b) in enumerate(pairs):
        if a is None:
            assert got[i] is None
            continue
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x, u in enumerate(a):
            for y, v in enumerate(b):
                t[x + 1][y + 1] = t[x][y] + 1 if u is not None and u == v else max(t[x][y + 1], t[x + 1][y])
        assert got[i] == t[-1][-1]


def test_kernels_with_holes_gaps_and_small_blocks(spark):
    """Windows of both generations against pandas, with missing samples, missing rows and keys of several types."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(460, 6)), columns=MAP.values())
    pdf["dev"], pdf["idx"] = np.where(np.arange(460) < 300, "a", None), np.r_[np.arange(300), np.arange(160)]
    pdf.loc[rng.random(460) < 0.2, "gx"] = None
    pdf = pdf[(pdf["idx"] != 120) | pdf["dev"].isna()]
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "ax double, ay double, az double, gx double, gy double, gz double, dev string, idx int").repartition(4)
    for size in (1 << 17, 70):
        got = WN.window_stats_v1(d, ["dev"], "idx", MAP, size=size).toPandas()
        assert sorted(got["win"][got["dev"] == "a"]) == [0, 3, 4] and sorted(got["win"][got["dev"].isna()]) == [0, 1]
        for _, g in got.iterrows():
            own = pdf[(pdf["dev"] == g["dev"]) if g["dev"] else pdf["dev"].isna()]
            w = own[(own["idx"] >= g["win"] * 50) & (own["idx"] < g["win"] * 50 + 100)].sort_values("idx")
            x = w["gx"].dropna().to_numpy()
            want = {"mean": x.mean(), "std": x.std(ddof=1), "iqr": np.subtract(*np.percentile(x, [75, 25])), "mad": np.median(np.abs(x - np.median(x))), "jerk_rms": np.sqrt((np.diff(x) ** 2).mean()) * 50}
            np.testing.assert_allclose([g[f"gyro_x_{k}"] for k in want], list(want.values()), rtol=1e-9)
    empty = WN.window_stats_v2(d.where("gx IS NULL AND idx < 0"), ["dev"], "idx", MAP)
    assert empty.count() == 0 and len(empty.columns) == 93


def test_greedy_chain_over_many_blocks(spark):
    """Steps of every length against a plain walk, with blocks shorter and longer than the steps."""
    rng = np.random.default_rng(4)
    t = np.unique(np.round(rng.uniform(0, 400, 500), 3))
    until = np.maximum.accumulate(t + rng.choice([0.2, 1.0, 7.0, 60.0], len(t), p=[0.4, 0.4, 0.17, 0.03]))
    want, at = [], -np.inf
    for a, u in zip(t, until):
        if a >= at - 1e-9:
            want.append(a)
            at = u
    d = spark.createDataFrame(pd.DataFrame({"dev": 1, "t": t, "until": until}))
    for block in (2.0, 50.0, 3600.0):
        assert sorted(r["t"] for r in LV.greedy_chain(d, ["dev"], "t", "until", F.lit(-1e300), block).collect()) == want
