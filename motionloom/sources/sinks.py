"""Table sinks. Raw data is never overwritten; the file committer makes every write all-or-nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, raw: bool = False) -> None:
    w = df.write.mode("errorifexists" if raw else "overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_captures(samples: DataFrame, reports: DataFrame, trial: str, device: str, path: str) -> DataFrame:
    """Training captures of the trials that passed: samples partitioned by trial, and the derived label rows.

    A trial that must be recollected never reaches the output.
    """
    ok = reports.filter(F.col("status") != "recollect_required").select(trial, "evidence_tier", "status")
    accepted = samples.join(ok, trial)
    accepted.write.mode("errorifexists").partitionBy(trial).parquet(path)
    stored = samples.sparkSession.read.parquet(path)
    return stored.groupBy(trial, device).agg(
        F.count(F.lit(1)).alias("row_count"), ((F.max("timestamp_monotonic_ns") - F.min("timestamp_monotonic_ns")) / 1e9).alias("duration_seconds"),
        F.max("evidence_tier").alias("evidence_tier"), F.max("sequence_id").alias("last_sequence_id"))


def write_lines(df: DataFrame, header: str, line: str, path: str) -> None:
    """Text files that each start with the header line (the vendor log layout)."""

    def with_header(batches):
        import pandas as pd

        first = True
        for b in batches:
            yield pd.concat([pd.DataFrame({line: [header]}), b], ignore_index=True) if first else b
            first = False

    df.select(line).mapInPandas(with_header, f"{line} string").write.text(path)


def write_small_files(df: DataFrame, file: str, line: str, path: str) -> None:
    """One text file per value of ``file`` (its name below ``path``) with that value's lines.

    For many small files: Spark's writer opens and commits each through Hadoop's file system, which on a local disk starts several processes
    a file. Here the tasks write them, each under a temporary name that is renamed when it is whole, so a repeated task repeats itself.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        name, out, made = None, None, set()

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{root}/{name}._part", f"{root}/{name}")

        for b in batches:
            names = b.column(file).dictionary_encode()
            codes = names.indices.to_numpy()
            starts = [0, *(i + 1 for i in (codes[1:] != codes[:-1]).nonzero()[0].tolist())] if len(codes) else []
            lines = b.column(line).to_pylist()
            for a, z in zip(starts, [*starts[1:], len(codes)]):
                now = names.dictionary[int(codes[a])].as_py()
                if now != name:
                    close()
                    name, folder = now, f"{root}/{now}".rpartition("/")[0]
                    if folder not in made:
                        fs.create_dir(folder)
                        made = {folder}
                    out = fs.open_output_stream(f"{root}/{name}._part")
                out.write("".join(f"{x}\n" for x in lines[a:z]).encode())
        close()
        return iter(())

    rows = df.filter(F.col(file).isNotNull() & F.col(line).isNotNull()).select(file, line)
    rows.repartition(file).sortWithinPartitions(file).mapInArrow(write, "written long").count()
