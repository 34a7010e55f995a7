"""Findings as partitioned tables; rendering is left to the reader."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_findings(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "append",
    files_per_value: int | None = None,
) -> None:
    """Write findings as Parquet, one folder per value of ``partition_by``.

    By default rows are not shuffled: every task writes to the folders it has rows for. With
    ``files_per_value`` rows move to at most that many tasks per value, by a hash of the
    row, so that a hot value is still written in parallel and a rare one in few files.
    """
    if partition_by and files_per_value:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value))
        df = df.repartition(*[F.col(c) for c in partition_by], salt)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_run(
    df: DataFrame, path: str, run: str, partition_by: list[str] | None = None, files_per_value: int = 1
) -> None:
    """Write the findings of one run to a folder of its own, ``run=<run>``, in place of what it held.

    Writing a run again leaves one copy, also where the second time finds nothing for a value of
    ``partition_by``; other runs are not touched. Each value is compacted to ``files_per_value``
    files. A run that was cut off is made whole by writing it again.
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", run):
        raise ValueError("a run is named by letters, digits, dashes and underscores, a letter first")
    write_findings(df, f"{path}/run={run}", partition_by, "overwrite", files_per_value)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
