"""Column functions: angles, quaternions, parsing, ids. All but the subsequence length run inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]


def rounded(x: Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, for stable reports."""
    return F.round(x, digits) + F.lit(0.0)


def norm(*xs: Column) -> Column:
    total = xs[0] * xs[0]
    for x in xs[1:]:
        total = total + x * x
    return F.sqrt(total)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def angle_wrap_diff(value: Column, base: Column) -> Column:
    """Signed shortest difference in degrees, in [-180, 180)."""
    return F.pmod(value - base + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def circular_mean(angle: Column) -> Column:
    """Aggregate: mean direction in degrees."""
    r = F.radians(angle)
    return F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))


def quat_normalise(q: Quat) -> Quat:
    n = F.greatest(norm(*q), F.lit(1e-9))
    return tuple(c / n for c in q)


def quat_product(a: Quat, b: Quat) -> Quat:
    """Hamilton product, scalar part first."""
    w1, x1, y1, z1 = a
    w2, x2, y2, z2 = b
    return (w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2,
            w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
            w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2,
            w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2)


def quat_conjugate(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def quat_from_euler(roll: Column, pitch: Column, yaw: Column) -> Quat:
    half = [F.radians(a) / 2 for a in (roll, pitch, yaw)]
    (cr, cp, cy), (sr, sp, sy) = [F.cos(h) for h in half], [F.sin(h) for h in half]
    return (cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy,
            cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def euler_from_quat(q: Quat) -> tuple[Column, Column, Column]:
    """Roll, pitch, yaw in degrees of a unit quaternion."""
    w, x, y, z = q
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(clip(2 * (w * y - z * x), -1.0, 1.0))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return tuple(F.degrees(a) for a in (roll, pitch, yaw))


def rotation_vector(q: Quat) -> tuple[Column, Column, Column]:
    """Axis times angle in degrees of a unit quaternion, on the short side (w >= 0)."""
    flip = F.when(q[0] < 0, -1.0).otherwise(1.0)
    w, v = q[0] * flip, [c * flip for c in q[1:]]
    m = norm(*v)
    scale = F.when(m > 1e-9, 2 * F.atan2(m, clip(w, -1.0, 1.0)) / m).otherwise(2.0)
    return tuple(F.degrees(c * scale) for c in v)


def quat_between(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Quat:
    """Rotation taking unit vector ``a`` to unit vector ``b``; antiparallel vectors turn about a normal."""
    dot = clip(a[0] * b[0] + a[1] * b[1] + a[2] * b[2], -1.0, 1.0)
    cross = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    usual = quat_normalise((1 + dot, *cross))
    # a x (1,0,0) unless a lies on that axis, then a x (0,1,0)
    zero = F.lit(0.0)
    along = norm(a[2], a[1]) < 1e-6
    axis = (F.when(along, -a[2]).otherwise(zero), F.when(along, zero).otherwise(a[2]), F.when(along, a[0]).otherwise(-a[1]))
    n = F.greatest(norm(*axis), F.lit(1e-9))
    opposite = (zero, *[c / n for c in axis])
    return tuple(F.when(dot < -0.999999, o).otherwise(u) for o, u in zip(opposite, usual))


def safe_number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.expr("try_cast(_ as double)") if text is None else text.try_cast("double"), F.lit(default))


def event_id(fields: dict[str, Column]) -> Column:
    """SHA-256 of canonical JSON: keys sorted, no spaces. Stable within this engine."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def map_argmax(m: Column) -> Column:
    """Key of the largest value; the smaller key wins a tie."""
    best = F.array_max(F.map_values(m))
    return F.array_min(F.map_keys(F.map_filter(m, lambda k, v: v == best)))


def map_sum_subset(m: Column, keys: list[str]) -> Column:
    return F.aggregate(F.map_values(F.map_filter(m, lambda k, v: k.isin(keys))), F.lit(0.0), lambda a, v: a + v)


def lcs_length(left: Column, right: Column) -> Column:
    """Longest common subsequence of two arrays of strings, in Arrow batches; NULL elements match nothing."""

    @F.pandas_udf("int")
    def lcs(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None:
                return None
            codes = {v: i for i, v in enumerate({*a, *b} - {None})}
            target, row = np.array([codes.get(v, -1) for v in b], int), np.zeros(len(b) + 1, int)
            for v in a:
                if v is not None:
                    row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(target == codes[v], row[:-1] + 1, 0)))
            return int(row[-1])

        return pd.Series([one(a, b) for a, b in zip(lefts, rights)], dtype="Int32")

    return lcs(left, right)


def register(spark: SparkSession) -> None:
    """Expose the scalar functions to SQL text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION angle_wrap_diff(v DOUBLE, b DOUBLE) RETURNS DOUBLE "
              "RETURN pmod(v - b + 180, 360) - 180")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION safe_number(t STRING, d DOUBLE) RETURNS DOUBLE "
              "RETURN coalesce(try_cast(t AS DOUBLE), d)")
