"""An extension beyond batch planning: marker counts and peaks over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_peaks(events: DataFrame, window: str = "1 hour", late: str = "2 hours", asset: str = "user_id") -> DataFrame:
    """(asset, start, markers, peak) by window; events later than ``late`` are left out. For streams and tables alike."""
    stamped = events.withColumn("_t", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    by = stamped.groupBy(F.col(asset), F.window("_t", window).alias("w"))
    return by.agg(F.count("*").alias("markers"), F.max(F.abs("value")).alias("peak")).select(asset, F.col("w.start").alias("start"), "markers", "peak")
