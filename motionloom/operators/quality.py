"""Recording and stream quality: summaries, profiles, flags and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import MAD_SCALE, longest_runs, over_limit, robust_limits
from .ordered import BLOCK_ROWS, block_window, exact_percentile, keep_core, one_row, spread_join, with_halo

FLAGS = ["missing_core_columns", "orientation_invalid", "short_recording", "sampling_rate_irregular", "unlabelled_action",
         "earphone_contact_artifact", "protocol_truncated", "mixed_action"]
MOTION_BLOCKERS = ["missing_core_columns", "short_recording", "unlabelled_action", "earphone_contact_artifact", "protocol_truncated", "mixed_action"]


def distinct_counts(df: DataFrame, key: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """Distinct combinations (NULL counts as a value) per key; every set is spread over its own values."""
    out = None
    for name, cols in sets.items():
        part = df.groupBy(*key, *cols).agg(F.lit(1).alias("_o")).groupBy(*key).agg(F.count(F.lit(1)).alias(name))
        out = part if out is None else out.join(part, key)
    return out


def recording_summary(df: DataFrame, key: list[str], row: str, host: str, chip: str, device: str, core: list[str]) -> DataFrame:
    """One audit row per recording. ``host`` and ``chip`` are seconds columns."""
    data = [c for c in df.columns if c not in key + [row]]
    missing = [c for c in core if c not in df.columns]
    at = F.when(F.col(host).isNotNull(), F.col(row))
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min_by(host, at).alias("_h0"), F.max_by(host, at).alias("_h1"))
    d = distinct_counts(df, key, {"_d_all": data, "_d_host": [host], "_d_chip": [chip]})
    devices = df.groupBy(*key, device).agg(F.lit(1).alias("_o")).groupBy(*key).agg(F.count(device).alias("device_count"))
    span = F.col("_h1") - F.col("_h0")
    duration = F.when(span > 0, span).otherwise((F.col("rows") - 1).cast("double"))
    n = F.col("rows")
    return g.join(d, key).join(devices, key).select(
        *key, "rows", duration.alias("duration_s"), F.when(duration > 0, (n - 1) / duration).alias("sample_rate_hz"),
        F.lit(len(data)).alias("columns"), F.lit(";".join(missing)).alias("missing_core_columns"),
        (n - F.col("_d_all")).alias("full_duplicate_rows"), ((n - F.col("_d_all")) / n).alias("full_duplicate_ratio"),
        ((n - F.col("_d_host")) / n).alias("host_timestamp_duplicate_ratio"), ((n - F.col("_d_chip")) / n).alias("onboard_timestamp_duplicate_ratio"),
        "device_count", F.col("_h0").alias("start_s"), F.pmod(F.col("_h0"), F.lit(86400.0)).alias("start_second_of_day"))


def channel_profile(long: DataFrame, key: list[str], idx: str, x: str, limit: Column, size: int = BLOCK_ROWS) -> DataFrame:
    """Profile of each (key) of a long channel table; ``limit`` is the physical limit of the row's channel."""
    v = F.col(x)
    d = with_halo(long, idx, 1, 0, size).withColumn("_prev", F.lag(x).over(block_window(key, idx)))
    d = keep_core(d).withColumns({"_step": F.abs(v - F.col("_prev")), "_hit": over_limit(v, limit)})
    runs = longest_runs(d, key, idx, {"longest_zero_run": v == 0, "_const": v == F.col("_prev")}, size)
    lim = robust_limits(long, key, x).join(
        robust_limits(d, key, "_step").withColumnsRenamed({"med": "jmed", "mad": "jmad"}), key, "full")
    unique = long.filter(v.isNotNull()).groupBy(*key, x).agg(F.lit(1).alias("_o")).groupBy(*key).agg(F.count(F.lit(1)).alias("unique_values"))
    z = lambda val, med, mad, t: F.coalesce(F.when(F.col(mad) > 1e-12, MAD_SCALE * F.abs(val - F.col(med)) / F.col(mad) > t), F.lit(False))
    ratio = lambda c: F.avg(c.cast("double"))
    j = spread_join(d, lim, key)
    stats = j.groupBy(*key).agg(
        F.count(x).alias("count"), ratio(v.isNull()).alias("missing_ratio"), ratio(F.coalesce(v == 0, F.lit(False))).alias("zero_ratio"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        ratio(z(v, "med", "mad", 8.0)).alias("robust_outlier_ratio"), ratio(z(F.col("_step"), "jmed", "jmad", 10.0)).alias("jump_ratio"),
        ratio(F.col("_hit")).alias("physical_limit_ratio"))
    out = stats.join(runs, key).join(unique, key, "left")
    return out.withColumns({"longest_constant_run": F.when(F.col("_const") > 0, F.col("_const") + 1).otherwise(0),
                            "unique_values": F.coalesce("unique_values", F.lit(0))}).drop("_const")


def quality_flags(missing: Column, orientation_ok: Column, duration: Column, rate: Column, activity: Column) -> Column:
    """Array of flags in fixed order; the activity terms are fixed values."""
    nominal = F.greatest(F.lit(50.0), F.bround(rate / 50.0, 0) * 50.0)
    tests = [F.trim(missing) != "", ~orientation_ok, duration < 20, F.abs(rate - nominal) / nominal > 0.15, activity.contains("未标注"),
             activity.contains("擦耳机"), activity.contains("提前终止"), activity.contains("+")]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in zip(FLAGS, tests)]))


def rate_mode(rate: Column) -> Column:
    return F.greatest(F.bround(rate / 50.0, 0), F.lit(1.0)) * 50.0


def usable(flags: Column, orientation_ok: Column) -> tuple[Column, Column]:
    motion = ~F.arrays_overlap(flags, F.array(*[F.lit(b) for b in MOTION_BLOCKERS]))
    return motion, motion & orientation_ok


def signal_quality(df: DataFrame, key: list[str], acc: list[str], gyro: list[str], acc_clip: float = 15.9, gyro_clip: float = 1990.0) -> DataFrame:
    """Missing and clipped share over all channel values, and the state."""
    k = len(acc) + len(gyro)
    nulls = sum((F.when(F.col(c).isNull() | F.isnan(c), 1.0).otherwise(0.0) for c in acc + gyro), F.lit(0.0))
    clips = sum((F.when(F.abs(F.col(c)) >= (acc_clip if c in acc else gyro_clip), 1.0).otherwise(0.0) for c in acc + gyro), F.lit(0.0))
    g = df.groupBy(*key).agg((F.avg(nulls) / k).alias("missing_ratio"), (F.avg(clips) / k).alias("clipped_ratio"))
    m, c = F.col("missing_ratio"), F.col("clipped_ratio")
    return g.withColumn("state", F.when((m > 0.02) | (c > 0.02), "poor").when((m > 0) | (c > 0.002), "fair").otherwise("good"))


def orientation_valid(df: DataFrame, key: list[str], angles: list[str], quats: list[str]) -> DataFrame:
    """Every angle has more than two values and the quaternions are not all zero.

    Three distinct values exist when some value differs from both the minimum and the maximum, so
    two passes of plain aggregates answer it without counting distinct values.
    """
    ends = df.groupBy(*key).agg(*[f(a).alias(f"_{n}_{a}") for a in angles for n, f in (("lo", F.min), ("hi", F.max))],
                                *[F.max(F.abs(F.col(q))).alias(f"_q_{q}") for q in quats])
    inner = lambda a: (F.col(a) > F.col(f"_lo_{a}")) & (F.col(a) < F.col(f"_hi_{a}"))
    some = spread_join(df.select(*key, *angles), ends, key).groupBy(*key).agg(
        *[F.bool_or(F.coalesce(inner(a), F.lit(False))).alias(f"_i_{a}") for a in angles],
        *[F.max(f"_q_{q}").alias(f"_q_{q}") for q in quats])
    ok = F.lit(True)
    for a in angles:
        ok = ok & F.col(f"_i_{a}")
    alive = F.lit(False)
    for q in quats:
        alive = alive | F.coalesce(F.col(f"_q_{q}") > 0, F.lit(False))
    return some.select(*key, (ok & alive).alias("orientation_valid"))


def stream_quality(df: DataFrame, key: list[str], idx: str, ts_ns: str, seq: str, acc: list[str], gyro: list[str], configured: Column,
                   acc_range: Column, gyro_range: Column, size: int = BLOCK_ROWS) -> DataFrame:
    """Strict stream checks; ``configured`` rate and ranges are columns constant per key."""
    w = block_window(key, idx)
    d = with_halo(df.withColumns({"_cfg": configured, "_ar": acc_range, "_gr": gyro_range}), idx, 1, 0, size)
    d = keep_core(d.withColumns({"_dt": F.col(ts_ns) - F.lag(ts_ns).over(w), "_ds": F.pmod(F.col(seq) - F.lag(seq).over(w), F.lit(65536))}))
    k = len(acc) + len(gyro)
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c), 1.0).otherwise(0.0) for c in acc + gyro), F.lit(0.0))
    clip = sum((F.when(F.abs(F.col(c)) >= 0.995 * F.col("_ar" if c in acc else "_gr"), 1.0).otherwise(0.0) for c in acc + gyro), F.lit(0.0))
    n_if = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    base = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("row_count"), (F.max_by(ts_ns, idx) - F.min_by(ts_ns, idx)).alias("_span"), F.max("_cfg").alias("configured_rate_hz"),
        n_if(F.col("_dt") <= 0).alias("reorder_count"), F.sum(F.greatest(F.col("_ds") - 1, F.lit(0))).alias("_gaps"),
        n_if(F.col("_ds") == 0).alias("sequence_duplicate_count"), (F.avg(clip) / k).alias("clipped_ratio"), (F.avg(bad) / k).alias("non_finite_ratio"))
    duration = F.greatest(F.lit(0.0), F.col("_span") / 1e9)
    base = base.withColumns({"duration_seconds": duration, "sequence_gap_count": F.coalesce("_gaps", F.lit(0))})
    base = base.withColumn("observed_rate_hz", F.when(duration > 0, (F.col("row_count") - 1) / duration).otherwise(0.0))
    step = F.greatest(F.lit(1e8), 3 * 1e9 / F.greatest(F.col("observed_rate_hz"), F.lit(1e-9)))
    long_gaps = spread_join(d.select(*key, "_dt"), base.select(*key, "observed_rate_hz"), key).groupBy(*key).agg(
        n_if(F.col("_dt") > step).alias("long_gap_count"))
    c = F.col
    rate_ok = c("observed_rate_hz").between(0.95 * c("configured_rate_hz"), 1.05 * c("configured_rate_hz"))
    issues = [(c("reorder_count") > 0, "timestamp_not_strictly_increasing"), (~rate_ok, "sample_rate_outside_5_percent"), (c("long_gap_count") > 0, "long_timestamp_gap"),
              (c("sequence_gap_count") > 0, "sequence_gap"), (c("sequence_duplicate_count") > 0, "sequence_duplicate_or_reorder"),
              (c("non_finite_ratio") > 0, "non_finite_sensor_value"), (c("clipped_ratio") > 0.002, "sensor_saturation")]
    return base.join(long_gaps, key).withColumn("issues", F.array_compact(F.array(*[F.when(t, n) for t, n in issues]))).drop("_span", "_gaps")


def prefer_source_format(df: DataFrame, sample: list[str], fmt: str, order: dict[str, int]) -> DataFrame:
    """Keep only the best format of each physical sample (csv before txt before others)."""
    rank = F.lit(len(order))
    for f, p in order.items():
        rank = F.when(F.col(fmt) == f, p).otherwise(rank)
    best = df.groupBy(*sample).agg(F.min(F.struct(rank, F.col(fmt))).alias("_b")).select(*sample, F.col("_b")[fmt].alias("_fmt"))
    return spread_join(df, best, sample, large=True).filter(F.col(fmt) == F.col("_fmt")).drop("_fmt")


def trainability_gate(iv: DataFrame, recordings: DataFrame, key: list[str], min_seconds: float = 4.0, allow_legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Window-eligible intervals, and a manifest with one ordered exclusion reason per recording.

    ``recordings`` has duration_s, label_trainable, evidence_tier; ``iv`` has start_s, end_s,
    window_trainable, phase, motion_state, wear_state, tier.
    """
    j = spread_join(iv, recordings.select(*key, "duration_s"), key, "inner")
    c = F.col
    j = j.withColumns({"start_s": F.greatest(F.lit(0.0), c("start_s")), "end_s": F.least(c("duration_s"), c("end_s"))})
    ok = (c("duration_s") <= 180) & c("window_trainable") & ~c("phase").isin("calibration", "transition")
    ok = ok & c("motion_state").isin("motion", "non_motion") & (c("wear_state") == "valid") & (c("end_s") - c("start_s") >= min_seconds)
    if not allow_legacy:
        ok = ok & (c("tier") == "gold")
    eligible = j.filter(ok)
    n = eligible.groupBy(*key).agg(F.count(F.lit(1)).alias("intervals"))
    m = recordings.join(n, key, "left").withColumn("intervals", F.coalesce("intervals", F.lit(0)))
    reason = (F.when(c("duration_s") > 180, "session_weak_over_180_seconds").when(c("label_trainable") == False, "label_marked_not_window_trainable"))  # noqa: E712
    if not allow_legacy:
        reason = reason.when(c("evidence_tier") == "legacy_reviewed", "legacy_evidence_requires_explicit_experimental_flag")
    reason = reason.when(c("intervals") == 0, "missing_or_unreviewed_dual_label").otherwise("")
    return eligible, m.withColumns({"included": c("intervals") > 0, "excluded_reason": reason})


def stable_pose(gyro_mean: Column, acc_std: Column, deviation: Column, label: Column) -> Column:
    still = (gyro_mean <= 12.0) & (acc_std <= 0.08)
    return still & F.when(label == "normal", deviation <= 12.0).otherwise(deviation >= 15.0)


def overview_by_dim(df: DataFrame, dim: str) -> DataFrame:
    """Sessions, counts and median duration/rate/duplicate ratio per dimension value."""
    med = None
    for c in ("duration_s", "sample_rate_hz", "full_duplicate_ratio"):
        m = exact_percentile(df, [dim], c, {f"{c}_median": 0.5})
        med = m if med is None else med.join(m, dim, "full")
    sessions = df.groupBy(dim, "capture_group").agg(F.count(F.lit(1)).alias("_n")).groupBy(dim).agg(
        F.count("capture_group").alias("sessions"), F.sum("_n").alias("samples"))
    return sessions.join(med, dim, "left")


def format_pairs(df: DataFrame, key: list[str]) -> DataFrame:
    """csv/txt pairs of one (capture, device): absolute differences. Exactly one row of each format."""
    cols = ["start_second_of_day", "duration_s", "sample_rate_hz", "rows"]
    side = lambda f: [F.max(F.when(F.col("source_format") == f, F.col(c))).alias(f"_{f}_{c}") for c in cols]
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("source_format") == "csv").cast("int")).alias("_c"),
                             F.sum((F.col("source_format") == "txt").cast("int")).alias("_t"), *side("csv"), *side("txt"))
    g = g.filter("_n = 2 AND _c = 1 AND _t = 1")
    names = ["start_offset_s", "duration_abs_diff_s", "sample_rate_abs_diff_hz", "row_count_abs_diff"]
    return g.select(*key, *[F.abs(F.col(f"_csv_{c}") - F.col(f"_txt_{c}")).alias(n) for c, n in zip(cols, names)])


def equivalent_exports(pairs: DataFrame) -> DataFrame:
    """Are csv and txt the same recordings? Medians of the pair differences against fixed limits."""
    names = ("start_offset_s", "duration_abs_diff_s", "sample_rate_abs_diff_hz")
    med = one_row(*[exact_percentile(pairs, [], c, {c: 0.5}) for c in names])
    test = (F.col("start_offset_s") < 0.1) & (F.col("duration_abs_diff_s") < 0.2) & (F.col("sample_rate_abs_diff_hz") < 0.1)
    return med.withColumn("equivalent", test)
