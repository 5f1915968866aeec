"""Streaming surface (an extension): glyph counts and repeated texts over a growing folder of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.glyphs import glyph_rows  # a stream is counted by row, in one aggregate


def documents(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def glyph_counts(docs: DataFrame) -> DataFrame:
    """Running counts by category; state is six rows."""
    return glyph_rows(docs).groupBy("glyph").agg(F.count(F.lit(1)).alias("n"))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by type in tumbling windows; rows later than the watermark are dropped, state is bounded by it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def first_seen(docs: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Texts not seen before within the watermark; state holds digests only."""
    return docs.withWatermark(time, late).withColumn("digest", F.md5(F.col("text").cast("binary"))).dropDuplicatesWithinWatermark(["digest"])
