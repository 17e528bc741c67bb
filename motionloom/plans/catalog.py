"""Loads every query module."""

from __future__ import annotations

from . import q_clean, q_eval, q_joins, q_labels, q_live, q_quality, q_scalar, q_sources, q_windows  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf):
    """imu6 -> cleaned axes -> window features, with each window's signal quality."""
    from pyspark.sql import functions as F

    from ..operators import clean as C
    from ..operators import quality as Q
    from ..operators import windows as WN
    from ..session import staged
    from .q_windows import MAP
    from .views import AXES, imu6

    raw = staged(imu6(spark, sf).select("device", "idx", *AXES), "flagship")
    c = staged(C.clean_channels(raw, ["device"], "idx", AXES, 50.0).select("device", "idx", *AXES), "clean")
    f = WN.window_stats_v2(c, ["device"], "idx", MAP)
    windows = WN.explode_windows(WN.blocked(raw, "idx", 200), "idx", 200, 50)
    q = Q.signal_quality(windows, ["device", "win"], AXES[:3], AXES[3:])
    return f.join(q.withColumnRenamed("state", "signal_quality"), ["device", "win"]).orderBy(F.col("device"), F.col("win"))
