"""Column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word split here (SPACE, TAB..CR), as a Java class and as the characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that may be broadcast: far below the memory of any executor (a row here is under 1 kB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column, separators: str = SPACE_CLASS) -> Column:
    """The words between runs of ``separators``; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), separators), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once: lambda arguments are not inlined as columns are."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of a row that is never null, also equal for repeated rows."""
    return F.xxhash64(doc_id, text)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
