"""Structured Streaming: the request log and observations as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.sources.tables import SCHEMAS


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files of the request log as a stream; replays within the watermark count once."""
    rows = spark.readStream.schema(SCHEMAS["fetch_log"]).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withWatermark("requested_at", "7 days").dropDuplicatesWithinWatermark(["seq"])


def hourly(log: DataFrame) -> DataFrame:
    """Requests and bytes by hour and outcome; late rows count until the watermark passes their hour."""
    return log.groupBy(F.window("requested_at", "1 hour").alias("hour"), "outcome").agg(
        F.count("*").alias("requests"), F.sum(F.coalesce("bytes_down", F.lit(0))).alias("bytes_down")
    ).select(F.col("hour.start").alias("hour"), "outcome", "requests", "bytes_down")


def sink_partitions(batch: DataFrame, epoch: int, folder: str) -> None:
    """One folder per epoch, written again when an epoch is repeated, so that results count once."""
    batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def start_hourly(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Run the hourly roll-up over what has arrived and stop."""
    out = hourly(read_log(spark, source))
    return out.writeStream.outputMode("append").foreachBatch(lambda df, epoch: sink_partitions(df, epoch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
