"""Window features over stacks of windows: arrays of (windows, rows, channels).

Spark cuts, ships and orders the windows (``operators.windows``) or buffers them (``streaming.scoring``); both call
these vectorised functions, so a stream and a batch have the same numbers. NaN is a missing sample.
"""

from __future__ import annotations

import numpy as np

AXES = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
PAIRS = [(f, a, b) for f in ("acc", "gyro") for a, b in ((0, 1), (0, 2), (1, 2))]
V2_CHANNELS = [*AXES, "acc_mag", "gyro_mag", "dynamic_acc"]
V2_STATS = ["mean", "std", "rms", "range", "iqr", "jerk_rms", "dominant_hz", "spectral_entropy", "period_s"]
V2_NAMES = [f"{c}_{s}" for c in V2_CHANNELS for s in V2_STATS] + ["acc_sma", "gravity_x", "gravity_y", "gravity_z"] + [f"{f}_corr_{'xyz'[a]}{'xyz'[b]}" for f, a, b in PAIRS]
V1_STATS = ["mean", "std", "rms", "range", "iqr", "mad", "jerk_rms", "dom_freq_hz", "spec_entropy"]


def spectral(x: np.ndarray, hz: np.ndarray, low: float = 0.2, high: float = 15.0, floor: float = 1e-15, entropy_floor: float = 1.0, min_samples: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(dominant frequency, entropy) of the rfft power of each row in [low, min(high, hz / 2)]; zeros without power, NaN below ``min_samples``."""
    n = x.shape[1]
    if n < max(1, min_samples):
        return np.full(len(x), np.nan), np.full(len(x), np.nan)
    freq = np.arange(n // 2 + 1) * (hz[:, None] / n)
    keep = (freq >= low) & (freq <= np.minimum(high, hz[:, None] / 2))
    power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2 * keep
    total, bins = power.sum(axis=1), keep.sum(axis=1)
    live = total > floor
    p = power / np.where(live, total, 1.0)[:, None]
    entropy = -(p * np.log2(p + 1e-15)).sum(axis=1) / np.maximum(np.log2(np.maximum(bins, 1)), entropy_floor)
    return np.where(live, freq[np.arange(len(x)), power.argmax(axis=1)], 0.0), np.where(live & (bins > 1), entropy, 0.0)


def period(x: np.ndarray, fs: float) -> np.ndarray:
    """Lag in seconds of the highest autocorrelation between fs / 4 and fs / 0.3 samples; equal peaks give the first."""
    n = x.shape[1]
    low, high = max(1, int(fs / 4.0)), min(n, int(fs / 0.3))
    if high <= low:
        return np.zeros(len(x))
    padded = np.fft.rfft(x - x.mean(axis=1, keepdims=True), 2 * n, axis=1)
    corr = np.fft.irfft(np.abs(padded) ** 2, 2 * n, axis=1)
    inside = corr[:, low:high]
    top = inside.max(axis=1, keepdims=True) - 1e-9 * corr[:, :1]
    return np.where(x.std(axis=1) < 1e-8, 0.0, (low + (inside >= top).argmax(axis=1)) / fs)


def rank(s: np.ndarray, p: float, count: np.ndarray | None = None) -> np.ndarray:
    """Linear-interpolated percentile along axis 1 of sorted values, of the first ``count`` of each."""
    at = (s.shape[1] - 1) * p if count is None else np.maximum(count - 1, 0) * p
    lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
    if count is None:
        a, b = s[:, lo], s[:, hi]
    else:
        a, b = (np.take_along_axis(s, np.expand_dims(i, 1), 1)[:, 0] for i in (lo, hi))
    return a + (b - a) * (at - lo)


def norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def along(x: np.ndarray) -> np.ndarray:
    """(windows, rows, channels) as (windows * channels, rows)."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])


def v2(x: np.ndarray, fs: float, names: list[str] | None = None) -> dict[str, np.ndarray]:
    """The second generation: population std, dynamic part about the window's median. ``x`` has the six axes, complete."""
    names = V2_NAMES if names is None else names
    acc_mag = norm(x[..., :3])
    dynamic = np.abs(acc_mag - rank(np.sort(acc_mag, axis=1), 0.5)[:, None])
    y = np.concatenate([x, np.stack([acc_mag, norm(x[..., 3:]), dynamic], -1)], -1)
    w, n, c = y.shape
    mean, std, s = y.mean(1), y.std(1), np.sort(y, axis=1)
    stats = {"mean": mean, "std": std, "rms": np.sqrt((y * y).mean(1)), "range": s[:, -1] - s[:, 0], "iqr": rank(s, 0.75) - rank(s, 0.25),
             "jerk_rms": np.sqrt((np.diff(y, axis=1) ** 2).mean(1)) * fs}
    ending = lambda *e: any(v.endswith(e) for v in names)
    if ending("dominant_hz", "spectral_entropy"):
        hz, entropy = spectral(along(y), np.full(w * c, float(fs)))
        stats |= {"dominant_hz": hz.reshape(w, c), "spectral_entropy": entropy.reshape(w, c)}
    if ending("period_s"):
        stats["period_s"] = period(along(y), fs).reshape(w, c)
    out = {f"{ch}_{name}": v[:, i] for name, v in stats.items() for i, ch in enumerate(V2_CHANNELS)}
    out["acc_sma"] = np.abs(x[..., :3] - mean[:, None, :3]).sum(-1).mean(1)
    length = np.maximum(norm(mean[:, :3]), 1e-9)
    out |= {f"gravity_{a}": mean[:, i] / length for i, a in enumerate("xyz")}
    for f, a, b in PAIRS:
        i, j = (a, b) if f == "acc" else (a + 3, b + 3)
        scale = std[:, i] * std[:, j]
        some = scale * n > 1e-12
        cov = ((y[..., i] - mean[:, None, i]) * (y[..., j] - mean[:, None, j])).mean(1)
        out[f"{f}_corr_{'xyz'[a]}{'xyz'[b]}"] = np.where(some, cov / np.where(some, scale, 1.0), 0.0)
    return {k: out[k] for k in names}


def v2_gaps(x: np.ndarray, fs: float, names: list[str] | None = None) -> dict[str, np.ndarray]:
    """``v2`` of windows with missing samples: they are skipped, and the dynamic part is missing where a whole acceleration is."""
    names = V2_NAMES if names is None else names
    acc = norm(x[..., :3])
    n, some = x.shape[1], lambda v: (~np.isnan(v)).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        average = lambda v: np.nansum(v, 1) / some(v)
        dynamic = np.abs(acc - rank(np.sort(acc, axis=1), 0.5, some(acc))[:, None])
        y = np.concatenate([x, np.stack([acc, norm(x[..., 3:])], -1)], -1)
        mean, s, count = average(y), np.sort(y, axis=1), some(y)
        std = np.sqrt(average((y - mean[:, None]) ** 2))
        last = np.take_along_axis(s, np.expand_dims(np.maximum(count - 1, 0), 1), 1)[:, 0]
        jerk = np.nan_to_num(np.sqrt(average(np.diff(y, axis=1) ** 2))) * fs
        stats = {"mean": mean, "std": std, "rms": np.sqrt(average(y * y)), "range": last - s[:, 0], "iqr": rank(s, 0.75, count) - rank(s, 0.25, count), "jerk_rms": jerk}
        d = np.sort(dynamic, axis=1)
        moved = {"mean": dynamic.mean(1), "std": dynamic.std(1), "rms": np.sqrt((dynamic * dynamic).mean(1)), "range": d[:, -1] - d[:, 0], "iqr": rank(d, 0.75) - rank(d, 0.25),
                 "jerk_rms": np.sqrt((np.diff(dynamic, axis=1) ** 2).mean(1)) * fs}
        out = {f"{ch}_{name}": v[:, i] for name, v in stats.items() for i, ch in enumerate(V2_CHANNELS[:-1])} | {f"dynamic_acc_{name}": v for name, v in moved.items()}
        for ch, v in zip(V2_CHANNELS, [*np.moveaxis(y, -1, 0), dynamic]):
            if any(name.startswith(ch) and name.endswith(("dominant_hz", "spectral_entropy", "period_s")) for name in names):
                out[f"{ch}_dominant_hz"], out[f"{ch}_spectral_entropy"] = spectral(v, np.full(len(v), float(fs)))
                out[f"{ch}_period_s"] = period(v, fs)
        out["acc_sma"] = average(np.abs(x[..., :3] - mean[:, None, :3]).sum(-1))
        length = np.fmax(norm(mean[:, :3]), 1e-9)
        out |= {f"gravity_{a}": mean[:, i] / length for i, a in enumerate("xyz")}
        for f, a, b in PAIRS:
            i, j = (a, b) if f == "acc" else (a + 3, b + 3)
            both = np.where(np.isnan(y[..., i] + y[..., j])[..., None], np.nan, y[..., [i, j]])
            cov = average(np.prod(both - average(both)[:, None], axis=-1))
            scale = std[:, i] * std[:, j]
            out[f"{f}_corr_{'xyz'[a]}{'xyz'[b]}"] = np.where(scale * n > 1e-12, cov / scale, 0.0)
    return {k: out[k] for k in names}


def live(x: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
    """The live subset of the first generation at the rate observed in each window (``t``: the samples' times); missing samples are skipped."""
    acc, n = norm(x[..., :3]), x.shape[1]
    y = np.concatenate([x, np.stack([acc, norm(x[..., 3:6]), np.abs(acc - 1.0)], -1)], -1)
    fs = (n - 1) / np.maximum(t[:, -1] - t[:, 0], 1e-6)
    real = ~np.isnan(y)
    count = real.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nansum(y, 1) / count
        std = np.sqrt(np.nansum((y - mean[:, None]) ** 2, 1) / (count - 1.0))
    std[count < 2] = np.nan
    out = {"fs": fs, **{f"{c}_mean": mean[:, i] for i, c in enumerate(V2_CHANNELS)}, **{f"{c}_std": std[:, i] for i, c in enumerate(V2_CHANNELS)}}
    for i, c in list(enumerate(V2_CHANNELS))[6:]:
        hz, entropy = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for m in np.unique(count[:, i]):
            at = np.flatnonzero(count[:, i] == m)
            if m:
                hz[at], entropy[at] = spectral(y[at, :, i][real[at, :, i]].reshape(len(at), m), fs[at], floor=0.0, entropy_floor=1e-12)
        out[f"{c}_dom_freq_hz"], out[f"{c}_spec_entropy"] = hz, entropy
    return out


def v1(x: np.ndarray, axes: list[str], fs: np.ndarray | float, names: list[str] | None = None, floor: float = 0.0) -> dict[str, np.ndarray]:
    """The first generation: sample std, MAD, dynamic part about 1 g; missing samples are skipped, below two a channel's features are missing.

    ``x`` has the channels ``axes`` (acc_x .. gyro_z first); ``fs`` may differ between windows.
    """
    acc_mag = norm(x[..., :3])
    y = np.concatenate([x, np.stack([acc_mag, norm(x[..., 3:6]), np.abs(acc_mag - 1.0)], -1)], -1)
    channels = [*axes, "acc_mag", "gyro_mag", "dynamic_acc"]
    w, n, c = y.shape
    rate = np.broadcast_to(np.asarray(fs, float), (w,))
    bad = np.isnan(y)
    count = n - bad.sum(1)
    if bad.any():  # the samples that exist, in order, then the missing ones
        y = np.take_along_axis(y, np.argsort(bad, axis=1, kind="stable"), 1)
    real = np.arange(n)[None, :, None] < count[:, None]
    k = np.maximum(count, 1)
    z = np.where(real, y, 0.0)
    mean = z.sum(1) / k
    far = np.where(real, y - mean[:, None], 0.0)
    s = np.sort(y, axis=1)
    median = rank(s, 0.5, count)
    mad = rank(np.sort(np.abs(y - median[:, None]), axis=1), 0.5, count)
    steps = np.where(real[:, 1:], np.diff(np.where(real, y, 0.0), axis=1), 0.0)
    jerk = np.where(count > 1, np.sqrt((steps ** 2).sum(1) / np.maximum(count - 1, 1)), 0.0) * rate[:, None]
    last = np.take_along_axis(s, np.expand_dims(np.maximum(count - 1, 0), 1), 1)[:, 0]
    stats = {"mean": mean, "std": np.sqrt((far ** 2).sum(1) / np.maximum(count - 1, 1)), "rms": np.sqrt((z * z).sum(1) / k), "range": last - s[:, 0],
             "iqr": rank(s, 0.75, count) - rank(s, 0.25, count), "mad": mad, "jerk_rms": jerk}
    if names is None or any(v.endswith(("dom_freq_hz", "spec_entropy")) for v in names):
        hz, entropy = np.full(w * c, np.nan), np.full(w * c, np.nan)
        rows, sizes, rates = along(y), count.ravel(), np.repeat(rate, c)
        for m in np.unique(sizes):
            at = np.flatnonzero(sizes == m)
            hz[at], entropy[at] = spectral(rows[at, :m], rates[at], floor=floor, entropy_floor=1e-12, min_samples=8)
        stats |= {"dom_freq_hz": hz.reshape(w, c), "spec_entropy": entropy.reshape(w, c)}
    stats = {name: np.where(count >= 2, v, np.nan) for name, v in stats.items()}
    out = {f"{ch}_{name}": v[:, i] for name, v in stats.items() for i, ch in enumerate(channels)}
    with np.errstate(invalid="ignore"):
        apart = np.abs(x[..., :3] - mean[:, None, :3]).sum(-1)
        some = ~np.isnan(apart)
        out["acc_sma"] = np.where(some.any(1), np.where(some, apart, 0.0).sum(1) / np.maximum(some.sum(1), 1), np.nan)
    return out if names is None else {k: out[k] for k in names}


def contrast(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Features that tell two actions apart; ``x`` has the six axes and three angles."""
    acc, gyro = norm(x[..., :3]), norm(x[..., 3:6])
    dynamic = np.abs(acc - rank(np.sort(acc, axis=1), 0.5)[:, None])
    hz = lambda m: spectral(m, np.full(len(m), float(fs)), 0.15, 3.0, floor=-1.0)[0]
    out = {"acc_mag_std": acc.std(1), "gyro_mag_mean": gyro.mean(1), "gyro_mag_std": gyro.std(1), "gyro_mag_p95": rank(np.sort(gyro, axis=1), 0.95),
           "acc_dynamic_p95": rank(np.sort(dynamic, axis=1), 0.95), "acc_dominant_hz": hz(acc), "gyro_dominant_hz": hz(gyro)}
    out |= {f"{a}_std": x[..., i].std(1) for i, a in enumerate(AXES)}
    angles = np.sort(x[..., 6:9], axis=1)
    return out | {f"angle_{a}_range_p90": rank(angles, 0.95)[:, i] - rank(angles, 0.05)[:, i] for i, a in enumerate("xyz")}


def partial_dft(x: np.ndarray, start: int, n: int, k0: int, bins: int) -> np.ndarray:
    """Share of samples ``start..`` in bins k0.. of an n-point DFT (chirp transform, any n)."""
    j, k = np.arange(len(x)), np.arange(bins)
    chirp = lambda m: np.exp(-1j * np.pi * ((m.astype(object) * m.astype(object)) % (2 * n)).astype(float) / n)
    turn = lambda m: np.exp(-2j * np.pi * (m % n) / n)
    size = 1 << int(np.ceil(np.log2(len(x) + bins)))
    wj, wk = chirp(j), chirp(k)
    kernel = np.zeros(size, complex)
    kernel[:bins] = 1 / wk
    kernel[size - len(x) + 1:] = 1 / wj[1:][::-1]
    y = np.fft.ifft(np.fft.fft(x * turn(j * k0) * wj, size) * np.fft.fft(kernel))[:bins] * wk
    return y * turn(start * (k0 + k))


def recording(x: np.ndarray, start: int, fs: float) -> dict[str, float] | None:
    """``contrast`` of one whole recording (rows, six axes and three angles) whose first row has the position ``start``; missing values are skipped.

    None where a feature has no value at all: no acceleration, neither gyroscope nor angles, or too few rows for a bin.
    """
    n = len(x)
    k0, k1 = int(np.ceil(0.15 * n / fs - 1e-9)), int(np.floor(min(3.0, fs / 2) * n / fs + 1e-9))
    acc, gyro = norm(x[:, :3]), norm(x[:, 3:6])
    real = lambda v: v[~np.isnan(v)]
    point = lambda v, p: rank(np.sort(real(v))[None], p)[0] if len(real(v)) else np.nan
    std = lambda v: real(v).std() if len(real(v)) else np.nan
    spans = {f"angle_{a}_range_p90": point(x[:, 6 + i], 0.95) - point(x[:, 6 + i], 0.05) for i, a in enumerate("xyz")}
    p95 = point(gyro, 0.95)
    if k1 < k0 or not len(real(acc)) or np.isnan([p95, *spans.values()]).all():
        return None
    hz = {}
    for name, m in (("acc", acc), ("gyro", gyro)):
        y = partial_dft(m - (real(m).mean() if len(real(m)) else np.nan), start, n, k0, k1 - k0 + 1)
        hz[f"{name}_dominant_hz"] = (k0 + int(np.argmax(y.real * y.real + y.imag * y.imag))) * fs / n
    return {"n": n, "acc_mag_std": std(acc), "gyro_mag_mean": real(gyro).mean() if len(real(gyro)) else np.nan, "gyro_mag_std": std(gyro), **{f"{a}_std": std(x[:, i]) for i, a in enumerate(AXES)},
            "gyro_mag_p95": p95, **spans, "acc_dynamic_p95": point(np.abs(acc - point(acc, 0.5)), 0.95), **hz}


def wrap(v: np.ndarray, base: np.ndarray | float) -> np.ndarray:
    return np.mod(v - base + 180.0, 360.0) - 180.0


def posture(x: np.ndarray, base: dict[str, np.ndarray], fs: float) -> dict[str, np.ndarray]:
    """Features relative to a neutral baseline: ``x`` has ax..gz, roll, pitch, yaw, q0..q3, ``base`` per window ax, ay, az, the angles and the quaternion."""
    n = x.shape[1]
    unit = lambda q: q / np.maximum(norm(q), 1e-9)[..., None]
    q = unit(x[..., 9:13])
    b = unit(np.stack([base[f"q{i}"] for i in range(4)], -1))[:, None]
    w1, x1, y1, z1 = b[..., 0], -b[..., 1], -b[..., 2], -b[..., 3]
    w2, x2, y2, z2 = (q[..., i] for i in range(4))
    turn = np.stack([w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2, w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2], -1)
    turn = np.where(turn[..., :1] < 0, -turn, turn)
    size = norm(turn[..., 1:])
    angle = 2 * np.arctan2(size, np.clip(turn[..., 0], -1.0, 1.0))
    scale = np.where(size < 1e-9, 2.0, angle / np.where(size < 1e-9, 1.0, size))
    vector = np.degrees(turn[..., 1:] * scale[..., None])
    values = {f"relative_{a}": wrap(x[..., 6 + i], base[a][:, None]) for i, a in enumerate(("roll", "pitch", "yaw"))}
    values |= {f"rotation_vector_{a}": vector[..., i] for i, a in enumerate("xyz")}
    out = {}
    for name, v in values.items():
        s = np.sort(v, axis=1)
        out |= {f"{name}_mean": v.mean(1), f"{name}_median": rank(s, 0.5), f"{name}_std": v.std(1), f"{name}_last": v[:, -1]}
        if name.startswith("relative"):
            out[f"{name}_range"] = s[:, -1] - s[:, 0]
    turned, gyro, acc = norm(vector), norm(x[..., 3:6]), norm(x[..., :3])
    out |= {"rotation_degrees_mean": turned.mean(1), "rotation_degrees_p95": rank(np.sort(turned, axis=1), 0.95), "gyro_mean_dps": gyro.mean(1), "gyro_p95_dps": rank(np.sort(gyro, axis=1), 0.95),
            "gyro_rms_dps": np.sqrt((gyro * gyro).mean(1)), "dynamic_acc_std_g": acc.std(1), "dynamic_acc_range_g": acc.max(1) - acc.min(1)}
    up, was = unit(x[..., :3].mean(1)), unit(np.stack([base[a] for a in ("ax", "ay", "az")], -1))
    out["gravity_change_degrees"] = np.degrees(np.arccos(np.clip((up * was).sum(-1), -1.0, 1.0)))
    out["window_seconds"] = np.full(len(x), (n - 1) / fs)
    return out | {f"relative_gravity_{a}": up[:, i] - was[:, i] for i, a in enumerate("xyz")}
