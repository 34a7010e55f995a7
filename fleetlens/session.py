"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", app: str = "fleetlens", **conf: str) -> SparkSession:
    """A local session for tests and measurements. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a folder of this machine only for a local master."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="fleetlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of tables that are no longer read, wherever it is stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder, so a lost executor does not restart the rounds."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed`, for rounds that join what they made: the size of the result is known, not estimated.

    A checkpoint keeps its plan's estimate, and that of a join is the product of both sides. Over
    rounds the estimate squares again and again, until planning takes all the time on a number of
    millions of digits. Of stored rows Spark knows the size.
    """
    held = df.persist()
    try:
        held.count()
        return checkpointed(held.select("*"))
    finally:
        held.unpersist()
