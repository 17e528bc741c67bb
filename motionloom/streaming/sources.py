"""Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tail_csv(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Follow a folder of recordings, oldest first. A file is read once it is closed (renamed into place)."""
    return (spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger)
            .option("latestFirst", False).option("recursiveFileLookup", True).csv(path))
