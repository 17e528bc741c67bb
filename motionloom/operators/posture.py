"""Calibrated posture: neutral baselines, window features, orientation sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalar as S
from ..functions.spectral import mean_quaternion
from ..functions.taxonomy import TRUSTED_REFERENCES
from .ordered import BLOCK_ROWS, exact_percentile
from .windows import kernel_windows, step_by_hop, window_rows

Q = ["q0", "q1", "q2", "q3"]


def neutral_baseline(df: DataFrame, key: list[str], acc: list[str], angles: list[str], quats: list[str] | None = None) -> DataFrame:
    """Per key: unit median gravity, circular mean angles and (optionally) the mean quaternion.

    The mean quaternion needs ten sums per key; only those reach the 4x4 eigenvector function.
    """
    middle = exact_percentile(df.select(*key, *acc).unpivot(key, acc, "_axis", "_x"), [*key, "_axis"], "_x", {"_g": 0.5})
    med = middle.groupBy(*key).agg(*[F.max(F.when(F.col("_axis") == a, F.col("_g"))).alias(f"_g_{a}") for a in acc]).dropna(subset=[f"_g_{a}" for a in acc])
    length = F.greatest(S.norm(*[F.col(f"_g_{a}") for a in acc]), F.lit(1e-9))
    aggs = [S.circular_mean(F.col(a)).alias(f"base_{a}") for a in angles]
    if quats:
        unit = S.quat_normalise(tuple(F.col(q) for q in quats))
        aggs += [F.sum(unit[i] * unit[j]).alias(f"_s{i}{j}") for i in range(4) for j in range(i, 4)]
    out = med.join(df.groupBy(*key).agg(*aggs), key)
    cols = [(F.col(f"_g_{a}") / length).alias(f"base_{a}") for a in acc] + [F.col(f"base_{a}") for a in angles]
    if quats:
        cols.append(mean_quaternion(F.array(*[F.col(f"_s{i}{j}") for i in range(4) for j in range(i, 4)])).alias("base_quat"))
    return out.select(*key, *cols)


def middle_of_segments(samples: DataFrame, idx: str, lo: Column, hi: Column) -> DataFrame:
    """Rows in the middle 15..85 % of their segment [lo, hi) (row numbers)."""
    n = hi - lo
    j = F.col(idx) - lo
    return samples.filter((j >= F.floor(0.15 * n)) & (j < F.floor(0.85 * n)))


def posture_windows(df: DataFrame, key: list[str], idx: str, base: dict[str, Column], fs: float = 50.0, window_s: float = 3.0, hop_s: float = 0.5,
                    size: int = BLOCK_ROWS) -> DataFrame:
    """Posture features of full, finite windows.

    ``df`` has ax..gz, roll, pitch, yaw, q0..q3; ``base`` maps ax, ay, az, roll, pitch, yaw, q0..q3 to
    baseline columns already joined to the rows.
    """
    n, step = window_rows(window_s, fs), step_by_hop(hop_s, fs)
    raw = ["ax", "ay", "az", "gx", "gy", "gz", "roll", "pitch", "yaw", *Q]
    d, neutral = df.withColumns({f"_b_{k}": v for k, v in base.items()}), list(base)

    def features(x: np.ndarray) -> dict[str, np.ndarray]:
        return K.posture(x[..., :len(raw)], {k: x[:, 0, len(raw) + i] for i, k in enumerate(neutral)}, fs)

    blank = K.posture(np.zeros((0, n, len(raw))), {k: np.zeros(0) for k in neutral}, fs)
    return kernel_windows(d, key, idx, [*raw, *[f"_b_{k}" for k in neutral]], n, step, list(blank), features, size, len(raw))


def orientation_source(df: DataFrame, source: Column, hw: list[str], hw_quat: list[str], fused: list[str]) -> DataFrame:
    """Hardware Euler angles win; their quaternion is built when absent. Six-axis fusion marks yaw degraded.

    ``hw`` and ``hw_quat`` are hardware columns, ``fused`` the seven columns of the six-axis fusion.
    """
    c = F.col
    hard = source.startswith("hardware") & c(hw[0]).isNotNull() & c(hw[1]).isNotNull() & c(hw[2]).isNotNull()
    hard = F.coalesce(hard, F.lit(False))
    built = S.quat_from_euler(*[c(h) for h in hw])
    have = c(hw_quat[0]).isNotNull()
    q = {f"q{i}": F.when(hard, F.when(have, c(hw_quat[i])).otherwise(built[i])).otherwise(c(fused[3 + i])) for i in range(4)}
    e = {n: F.when(hard, c(h)).otherwise(c(f)) for n, h, f in zip(("roll", "pitch", "yaw"), hw, fused)}
    return df.withColumns({**e, **q, "orientation_source": F.when(hard, source).otherwise("six_axis_relative"),
                           "yaw_reliability": F.when(hard, "reliable").otherwise("degraded")})


def posture_segments(segments: DataFrame) -> DataFrame:
    """One of five classes per trainable segment, by fixed priority; forward-head needs a trusted reference."""
    c = F.col
    has = lambda *n: F.arrays_overlap(c("deviations"), F.array(*[F.lit(x) for x in n]))
    doubtful = has("forward_head_candidate") & ~F.coalesce(c("reference_source").isin(TRUSTED_REFERENCES), F.lit(False))
    label = (F.when(c("posture_state") == "normal", "normal").when(has("head_down"), "head_down").when(has("head_up"), "head_up")
             .when(has("head_tilt_left", "head_tilt_right"), "head_tilt").when(has("head_turn_left", "head_turn_right"), "head_turn"))
    d = segments.filter(c("window_trainable") & ~F.coalesce(doubtful, F.lit(False))).withColumn("label", label)
    return d.filter("label IS NOT NULL")
