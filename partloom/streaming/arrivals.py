"""Structured Streaming over arriving point files: an extension, the batch operators stay the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def point_stream(spark: SparkSession, path: str, schema: str = "cloud int, pid long, x double, y double, z double, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def cloud_counts(points: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Points and mean height per cloud and window of event time; later rows than the watermark are dropped."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", window), "cloud").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"))


def run_batches(points: DataFrame, operator, path: str, checkpoint: str):
    """Every micro-batch through a batch operator, appended as Parquet in a folder per batch id, so that a batch that
    is run again replaces its own output."""

    def write(df: DataFrame, batch: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
