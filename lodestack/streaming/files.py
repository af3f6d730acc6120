"""Structured Streaming: files of a format decoded as they arrive, and windowed and session counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import decode

_BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arriving(spark: SparkSession, path: str, table: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of ``table`` for each file that arrives under a path; stateless, so exactly once with any sink that is."""
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return decode(reader.load(path).select(F.col("path").alias("file"), "content"), table)


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, lateness: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of windows; what is later than the watermark is dropped from the state."""
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of a key's events with no gap as long as ``gap``."""
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")
