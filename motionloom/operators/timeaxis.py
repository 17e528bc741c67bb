"""Time axes: parsing, rebuilding, durations, rollovers, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Scan, block_scan, spread_join

DATE_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TIME_ONLY = "HH:mm:ss.SSSSSS"
G_TO_MPS2 = 9.80665


def parse_host_time(df: DataFrame, key: list[str], row: str, text: str, out: str = "host_ts") -> DataFrame:
    """Parse clock text; the first non-null sample of a key decides whether its texts carry a date."""
    t = F.trim(F.col(text))
    first = df.groupBy(*key).agg(F.min_by(t, F.when(F.col(text).isNotNull(), F.col(row))).alias("_first"))
    dated = F.coalesce(F.col("_first").contains(" "), F.lit(False))
    parsed = F.when(dated, F.try_to_timestamp(t, F.lit(DATE_TIME))).otherwise(F.try_to_timestamp(t, F.lit(TIME_ONLY)))
    return spread_join(df, first, key).withColumn(out, parsed).drop("_first")


def _clock(df: DataFrame, key: list[str], row: str, host: str, chip: str) -> DataFrame:
    """Per key: rows, span in seconds and the source of the clock that is used."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in (host, chip):
        at = F.when(F.col(c).isNotNull(), F.col(row))
        aggs += [F.count(c).alias(f"_n_{c}"), (F.max_by(c, at) - F.min_by(c, at)).alias(f"_s_{c}")]
    ok = {c: (F.col(f"_n_{c}") >= 2) & (F.col(f"_s_{c}") > 0) for c in (host, chip)}
    g = df.groupBy(*key).agg(*aggs)
    return g.select(*key, "n",
                    F.when(ok[host], F.col(f"_s_{host}")).when(ok[chip], F.col(f"_s_{chip}")).alias("_span"),
                    F.when(ok[host], "host").when(ok[chip], "onboard").otherwise("sample_index").alias("time_source"))


def time_axis(df: DataFrame, key: list[str], idx: str, host: str, chip: str, out: str = "analysis_time_s") -> DataFrame:
    """Even seconds over the span of the first usable clock (seconds columns), else the sample index."""
    i = F.col(idx).cast("double")
    even = F.when(F.col("n") > 1, F.col("_span") * i / (F.col("n") - 1)).otherwise(F.lit(0.0))
    joined = spread_join(df, _clock(df, key, idx, host, chip), key)
    return joined.withColumn(out, F.when(F.col("_span").isNotNull(), even).otherwise(i)).drop("n", "_span")


def sampling_info(df: DataFrame, key: list[str], row: str, host: str, chip: str) -> DataFrame:
    d = F.coalesce(F.col("_span"), (F.col("n") - 1).cast("double"))
    return _clock(df, key, row, host, chip).select(
        *key, d.alias("duration_s"), F.when(d > 0, (F.col("n") - 1) / d).alias("sample_rate_hz"), "time_source")


def recording_duration(df: DataFrame, key: list[str], row: str, seconds: str, fallback_hz: float = 100.0) -> DataFrame:
    """Last minus first valid clock; a negative span crossed midnight; without a clock count rows."""
    at = F.when(F.col(seconds).isNotNull(), F.col(row))
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(seconds).alias("_v"),
                             (F.max_by(seconds, at) - F.min_by(seconds, at)).alias("_d"))
    d = F.when(F.col("_v") < 2, F.greatest(F.lit(0.0), (F.col("n") - 1) / F.lit(fallback_hz))).when(
        F.col("_d") < 0, F.col("_d") + 86400.0).otherwise(F.col("_d"))
    return g.select(*key, d.alias("duration_s"))


def unwrap_time_of_day(df: DataFrame, key: list[str], order: list[str], block: Column, tod: str) -> DataFrame:
    """Add ``day`` (midnights passed) and ``backwards`` (a step back that is no midnight: an error row)."""
    c = F.col(tod)
    d = block_scan(df, key, order, block, [Scan("_prev", c, "last", inclusive=False)])
    d = d.withColumns({"_flip": F.coalesce((F.col("_prev") - c) > 43200, F.lit(False)).cast("int"),
                       "backwards": F.coalesce((c < F.col("_prev")) & (F.col("_prev") - c <= 43200), F.lit(False))})
    return block_scan(d, key, order, block, [Scan("day", F.col("_flip").cast("long"), "sum")]).drop("_prev", "_flip")


def capture_bucket(ts: Column, activity: Column, seconds: int = 20) -> Column:
    """``date__activity__HHMMSS`` with the clock rounded to the bucket, half to even."""
    stamp = F.timestamp_seconds(F.bround(F.unix_micros(ts) / F.lit(seconds * 1e6), 0).cast("long") * seconds)
    return F.concat_ws("__", F.date_format(ts, "yyyy-MM-dd"), activity, F.date_format(stamp, "HHmmss"))


def derive_magnitudes(df: DataFrame, acc: list[str], gyro: list[str]) -> DataFrame:
    square = lambda cols: sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0]))
    return df.withColumns({"acc_mag": F.sqrt(square(acc)), "gyro_mag": F.sqrt(square(gyro))}).withColumn(
        "dynamic_acc", F.abs(F.col("acc_mag") - 1.0))


def to_si_units(df: DataFrame, acc: list[str], gyro: list[str], acc_unit: Column, gyro_unit: Column,
                signs: list[Column]) -> DataFrame:
    """Axis signs, then m/s2 and rad/s; an unknown unit fails the job."""
    a = F.when(acc_unit == "g", G_TO_MPS2).when(acc_unit.isin("m/s2", "m/s²"), 1.0).otherwise(
        F.raise_error(F.concat(F.lit("unsupported acceleration unit "), acc_unit)).cast("double"))
    g = F.when(gyro_unit.isin("deg/s", "°/s"), 3.141592653589793 / 180.0).when(gyro_unit == "rad/s", 1.0).otherwise(
        F.raise_error(F.concat(F.lit("unsupported angular velocity unit "), gyro_unit)).cast("double"))
    return df.withColumns({**{c: F.col(c) * s * a for c, s in zip(acc, signs)},
                           **{c: F.col(c) * s * g for c, s in zip(gyro, signs)}})


def project_channels(df: DataFrame, mapping: dict[str, str], keep: list[str]) -> DataFrame:
    """Rename vendor columns to channels; rows that lack one are skipped, unreadable numbers become 0."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        return df.limit(0).select(*keep, *[F.lit(0.0).alias(v) for v in mapping.values()])
    present = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in mapping))
    return present.select(*keep, *[F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(v)
                                   for c, v in mapping.items()])
