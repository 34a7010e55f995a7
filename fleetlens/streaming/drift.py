"""Drift events in tumbling windows, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.sources.findings import read_findings, write_run


def drift_windows(events: DataFrame, width: str = "4 hours", watermark: str = "1 hour") -> DataFrame:
    """Drift events (ts, env_id, is_drift) per environment and window.

    Windows are aligned to the epoch. On a stream, rows later than ``watermark`` behind the
    newest one are dropped and a window is emitted once it is closed; on a batch the
    watermark has no effect. State is one counter per open window and environment. In a
    batch, events without a time are counted under no window; a stream drops them.
    """
    if events.isStreaming:
        # watermarks need a timestamp with time zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        counted = events.filter("is_drift").groupBy(F.window("ts", width).alias("_w"), "env_id").agg(F.count("*").alias("n"))
        return counted.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "env_id", "n")
    timeless = F.col("ts").isNull()
    epoch = F.lit("1970-01-01 00:00:00").cast(events.schema["ts"].dataType)
    return (
        events.filter("is_drift")
        .select("env_id", timeless.alias("_none"), F.coalesce("ts", epoch).alias("ts"))
        .groupBy(F.window("ts", width).alias("_w"), "_none", "env_id")
        .agg(F.count("*").alias("n"))
        .select(
            F.when(~F.col("_none"), F.col("_w.start")).alias("window_start"),
            F.when(~F.col("_none"), F.col("_w.end")).alias("window_end"), "env_id", "n",
        )
    )


def start_drift_windows(events: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append closed windows to Parquet for what is available now; restart from ``checkpoint``."""
    return (
        drift_windows(events, **options)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def start_drift_counts(events: DataFrame, path: str, checkpoint: str, width: str = "4 hours") -> StreamingQuery:
    """Count what is available now into ``path``, a run of its own for every micro-batch.

    Nothing is dropped: each batch counts its rows, late ones and those without a time too, and
    writes a few rows per window. A batch that is done again after a failure replaces its run,
    as its number is kept in ``checkpoint``. ``read_drift_counts`` adds the runs up.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_run(drift_windows(batch, width), path, f"batch-{number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_drift_counts(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as ``drift_windows`` of all events that the stream has seen."""
    return read_findings(spark, path).groupBy("window_start", "window_end", "env_id").agg(F.sum("n").alias("n"))
