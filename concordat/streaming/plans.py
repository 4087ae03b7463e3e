"""Streams: documents arriving as files, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def arriving_files(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 100) -> DataFrame:
    """New files with their content id; a file seen before by content is passed on once.

    The state of ``dropDuplicates`` grows with the distinct contents; bound it with a watermark
    on ``modificationTime`` where old contents may be forgotten.
    """
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_trigger))
        .schema("path string, modificationTime timestamp, length long, content binary").load(path)
    )
    return files.withColumn("document_id", F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 20))).dropDuplicates(["document_id"])


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in hours; on a stream, late rows count until the watermark passes."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(20,2)").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
