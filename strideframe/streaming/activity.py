"""Streaming twins of the windowed queries: the same groupings over an unbounded observation stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.observations import OBSERVATION


def read_stream(spark: SparkSession, path: str, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Observation lines that arrive as files in `path`; `at` is the start of the recording plus the row's seconds."""
    df = spark.readStream.schema(OBSERVATION).json(path)
    return df.withColumn("at", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("timestamp_seconds") * 1_000_000).cast("long")))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Observations, tracks (approximate, as exact distinct counts need unbounded state) and mean confidence per analysis and window."""
    windows = stream.withWatermark("at", late).groupBy("analysis_id", F.window("at", width).alias("w"))
    out = windows.agg(F.count(F.lit(1)).alias("observations"), F.approx_count_distinct("track_id").alias("tracks"), F.avg("confidence").alias("confidence"))
    return out.select("analysis_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "observations", "tracks", "confidence")


def track_sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a track: a new one where no row came for longer than `gap`."""
    sessions = stream.withWatermark("at", late).groupBy("analysis_id", "track_id", F.session_window("at", gap).alias("s"))
    out = sessions.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("observations"))
    return out.drop("s")


def write_windows(windows: DataFrame, path: str, checkpoint: str, every: str = "1 minute"):
    """Closed windows appended to Parquet, exactly once per checkpoint."""
    return windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
