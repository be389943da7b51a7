"""Extension: pages that arrive as files, deduplicated by normalised URL within a watermark and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.functions.urls import normalize_url


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema("url string, html string, fetched_at timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def fresh_pages(pages: DataFrame, within: str = "7 days") -> DataFrame:
    """First sight of each normalised URL; state older than the watermark is dropped."""
    return pages.withColumn("key", normalize_url(F.col("url"))).withWatermark("fetched_at", within).dropDuplicatesWithinWatermark(["key"]).drop("key")


def append_pages(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return pages.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
