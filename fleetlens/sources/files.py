"""Files read incrementally: a run sees what is new, changed or gone since the runs before it.

A run lists the folder, compares the listing with its ledger and stages the differences; contents
are read of those files only; committing the run adds the staged differences to the ledger. A run
that fails before it commits is done again under its number and sees the same files, also where an
earlier try was committed: only lower numbers count as known. Nothing of the folder is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.findings import write_run

#: Bytes up to which a file is read as one text.
MAX_BYTES = 64 << 20
_STATE = ["path", "modified", "length"]
_LEDGER = "name string, path string, modified timestamp, length bigint, change string, number bigint"


#: How many tasks list folders, and whether Spark keeps listings in the driver for later, which none here is asked for again.
_LISTING_TASKS, _KEPT = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.manageFilesourcePartitions"


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by as many tasks as a shuffle has; else each folder is a task, up to 10,000."""
    before = {key: spark.conf.get(key) for key in (_LISTING_TASKS, _KEPT)}
    spark.conf.set(_LISTING_TASKS, min(int(before[_LISTING_TASKS]), max(_parts(spark), 8)))
    spark.conf.set(_KEPT, "false")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def list_files(spark: SparkSession, folder: str, glob: str = "*.json", name: str | None = None) -> DataFrame:
    """(name, path, modified, length) of the files below ``folder``; no content is read.

    ``name`` is a regular expression whose first group names the document that a path holds; a path
    without a match, and every path if there is no ``name``, is its own name. Of several files of
    one name the last modified counts, and of those the last path. A file without a byte is no
    file, as Spark's scans leave it out; one that is emptied counts as removed.
    """
    with _listing(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    # a few files make a partition of the scan, many of these a task
    files = found.select("path", F.col("modificationTime").alias("modified"), "length").coalesce(_parts(spark))
    if name is None:
        return files.select(F.col("path").alias("name"), *_STATE)
    called = F.when(F.col("path").rlike(name), F.regexp_extract("path", name, 1)).otherwise(F.col("path"))
    newest = F.max_by(F.struct(*_STATE), F.struct("modified", "path")).alias("_f")
    return files.groupBy(called.alias("name")).agg(newest).select("name", "_f.*")


def known_files(spark: SparkSession, ledger: str, before: int) -> DataFrame:
    """What the runs below number ``before`` have seen last, without files that are gone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "run=*")):
        return spark.createDataFrame([], _LEDGER).select("name", *_STATE)
    last = F.max_by(F.struct(*_STATE, "change"), "number").alias("_f")
    seen = spark.read.schema(_LEDGER).parquet(ledger).filter(F.col("number") < before).groupBy("name").agg(last)
    return seen.filter("_f.change <> 'removed'").select("name", *[F.col(f"_f.{c}").alias(c) for c in _STATE])


def file_changes(listed: DataFrame, known: DataFrame) -> DataFrame:
    """(name, path, modified, length, change) of names that are new, changed or removed.

    A removed name keeps what was known of it. Files are told apart by path, time and length.
    """
    old = known.select(F.col("name").alias("_name"), F.struct(*_STATE).alias("_old"))
    new = listed.select("name", F.struct(*_STATE).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    )
    met = new.join(old, F.col("name") == F.col("_name"), "full_outer").select(
        F.coalesce("name", "_name").alias("name"), F.coalesce("_new", "_old").alias("_f"), change.alias("change")
    )
    return met.filter("change IS NOT NULL").select("name", "_f.*", "change")


def stage_changes(
    spark: SparkSession, folder: str, ledger: str, number: int, glob: str = "*.json", name: str | None = None
) -> DataFrame:
    """The changes of run ``number``, written beside the ledger so that reading and committing agree on them."""
    changes = file_changes(list_files(spark, folder, glob, name), known_files(spark, ledger, number))
    write_run(changes.withColumn("number", F.lit(number).cast("bigint")), f"{ledger}/_staged", f"run-{number}")
    return staged_changes(spark, ledger, number)


def staged_changes(spark: SparkSession, ledger: str, number: int) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(f"{ledger}/_staged/run=run-{number}")


def commit_changes(spark: SparkSession, ledger: str, number: int) -> None:
    """Make the staged changes of a run known to later runs; doing it again changes nothing."""
    write_run(staged_changes(spark, ledger, number), ledger, f"run-{number}")


def read_changed(changes: DataFrame, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``text`` and ``file_error`` to changes; a file that cannot be read is a row with an error.

    Only files in the changes' range of times are opened. What was removed has neither text nor
    error. A file that went or broke since the listing, one longer than ``max_bytes``, and one
    that is not UTF-8 have an error; a byte order mark is left out of the text.
    """
    spark = changes.sparkSession
    wanted = changes.filter((F.col("change") != "removed") & (F.col("length") <= max_bytes))
    since = wanted.agg(F.min("modified")).first()[0]
    with _listing(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(folder)
    contents = (
        found.filter((F.col("modificationTime") >= F.lit(since)) & (F.col("length") <= max_bytes))
        .select(F.col("path").alias("_path"), F.col("content").cast("string").alias("_text"))
        .coalesce(_parts(spark))
    )
    valid = F.is_valid_utf8("_text")
    error = (
        F.when(F.col("change") == "removed", F.lit(None).cast("string"))
        .when(F.col("length") > max_bytes, f"file is longer than {max_bytes} bytes")
        .when(F.col("_text").isNull(), "file could not be read")
        .when(~valid, "file is not UTF-8")
    )
    kept = F.when((F.col("change") != "removed") & valid, F.regexp_replace("_text", "^\ufeff", ""))
    # staged changes are one file, what is done with the texts is not for one task
    met = changes.repartition(_parts(spark), "path").join(contents, (F.col("path") == F.col("_path")) & (F.col("change") != "removed"), "left")
    return met.select("name", *_STATE, "change", kept.alias("text"), error.alias("file_error"))
