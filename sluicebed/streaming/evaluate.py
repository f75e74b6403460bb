"""The resumable loop as a stream: new result files are scored once, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebed.operators.review import verdict
from sluicebed.plans.shared import place


def unique_stream(rows: DataFrame, keys: tuple[str, ...] = ("id", "malicious", "mode"), time: str = "evaluated_at", late: str = "60 days") -> DataFrame:
    """Rows of a stream without repeated keys; a key is kept in state until the watermark passes it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def rescored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("verdict", verdict(F.coalesce("response", F.lit(""))))


def hourly(rows: DataFrame, time: str = "evaluated_at", late: str = "60 days", width: str = "1 day") -> DataFrame:
    """Verdict counts by event-time window and mode."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "mode", "verdict").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a stream gives now: written by a checkpointed query into the shared folder and read back."""
    spark: SparkSession = stream.sparkSession
    base = place(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").start(f"{base}/rows").awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
