"""The windowed count over a stream gives the batch's rows."""

from pyspark.sql import functions as F

from fleetlens.plans.fleet_tables import fleet_table
from fleetlens.streaming import drift


def rows(df):
    return {(r["window_start"], r["env_id"], r["n"]) for r in df.collect()}


def test_stream_equals_batch(spark, small, tmp_path):
    events = fleet_table(spark, small, "drift_events")
    source = str(tmp_path / "in")
    # a last row far ahead closes every window that has data
    ahead = events.agg(
        F.lit(-1).cast("bigint").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(0).alias("env_id"), F.lit(True).alias("is_drift")
    )
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    drift.start_drift_windows(stream, out, state, watermark="400 days").awaitTermination()
    assert spark.read.parquet(out).count() == 0
    ahead.withColumn("ts", F.col("ts") + F.expr("INTERVAL 800 DAYS")).write.mode("append").parquet(source)
    drift.start_drift_windows(stream, out, state, watermark="400 days").awaitTermination()
    batch = rows(drift.drift_windows(events))
    assert rows(spark.read.parquet(out)) == {r for r in batch if r[0] is not None}
    assert any(r[0] is None for r in batch)


def test_late_rows_are_dropped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, env_id int, is_drift boolean"

    def add(*times):
        spark.createDataFrame([(t, 0, True) for t in times], "t string, env_id int, is_drift boolean").select(
            F.to_timestamp("t").alias("ts"), "env_id", "is_drift"
        ).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        drift.start_drift_windows(stream, out, state).awaitTermination()

    add("2024-01-01 01:00:00", "2024-01-01 03:59:59")
    add("2024-01-01 09:00:00")
    add("2024-01-01 02:00:00", "2024-01-02 00:00:00")
    got = sorted((str(r["window_start"]), r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-01 08:00:00", 1)]
