"""Observation sources: JSON and JSONL files with an explicit schema, and a view of the driver's `events` as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.policy import Court
from ..session import table

OBSERVATION = (
    "analysis_id string, frame_index long, timestamp_seconds double, track_id long, confidence double, "
    "bounding_box struct<x1: double, y1: double, x2: double, y2: double>, image_ground_point array<double>, court_position array<double>, "
    "inside_court boolean, inside_extended_court boolean, excluded boolean, interpolated boolean"
)


def read_observations(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """JSON lines as observations. on_error: 'raise' at the first bad line, 'drop' bad lines, 'keep' them in `_corrupt_record`."""
    mode = {"raise": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[on_error]
    schema = OBSERVATION + (", _corrupt_record string" if on_error == "keep" else "")
    df = spark.read.schema(schema).option("mode", mode).json(path)
    return df.withColumns({"court_x": F.try_element_at("court_position", F.lit(1)), "court_y": F.try_element_at("court_position", F.lit(2))})


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, problem) of every line of JSON lines that is no observation: NOT_JSON, NO_TIME without frame or seconds, NOT_FINITE with a court position that is no
    pair of finite numbers. Blank lines are none.

    A line's number is its place in its block of the file and the lines of the blocks before, so that files are read in parts.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))  # a row per read partition and file
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    row = F.from_json("value", OBSERVATION + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where(F.trim("value") != "").withColumn("r", row)
    finite = (F.size("r.court_position") == 2) & F.forall("r.court_position", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    problem = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "NOT_JSON").when(F.col("r.frame_index").isNull() | F.col("r.timestamp_seconds").isNull(), "NO_TIME").when(~F.coalesce(finite, F.lit(False)), "NOT_FINITE")
    bad = rows.withColumn("problem", problem).where("problem IS NOT NULL")
    return bad.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "problem")


def checked_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of JSON lines; an error that names the first bad line if there is one."""
    first = bad_lines(spark, path).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}, line {first[0]['line']}: {first[0]['problem']}")
    return read_observations(spark, path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents (reports, manifests), one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_observations(df: DataFrame, path: str) -> None:
    df.drop("court_x", "court_y").write.mode("error").json(path)


def observations(spark: SparkSession, sf_dir: str, court: Court = Court()) -> DataFrame:
    """`events` as observations: ids, microseconds since 2024-01-01, confidence and court position follow from integers of the row."""
    event = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("analysis_id"),
        F.col("user_id").alias("player_id"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts_us"),
        event.alias("frame_index"),
        ((event * 37) % 101 / F.lit(100.0)).alias("confidence"),
        ((event * 7919) % 2600 / F.lit(100.0) - 3.0).alias("court_x"),
        ((event * 104729) % 5000 / F.lit(100.0) - 3.0).alias("court_y"),
        "value",
    )
    return df.withColumns(
        {
            "track_id": F.col("player_id") * 10 + F.expr("ts_us div 864000000000"),
            "inside": G.inside(F.col("court_x"), F.col("court_y"), court),
            "extended": G.inside(F.col("court_x"), F.col("court_y"), court, court.margin),
        }
    )


#: The same view for DuckDB, as a common table expression.
OBS_SQL = """
obs AS (
  SELECT *, player_id * 10 + ts_us // 864000000000 AS track_id, court_x BETWEEN 0 AND 20 AND court_y BETWEEN 0 AND 44 AS inside,
    court_x BETWEEN -3 AND 23 AND court_y BETWEEN -3 AND 47 AS extended
  FROM (SELECT user_id % 10 AS analysis_id, user_id AS player_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS ts_us, event_id AS frame_index,
      ((event_id * 37) % 101)::DOUBLE / 100.0::DOUBLE AS confidence, ((event_id * 7919) % 2600)::DOUBLE / 100.0::DOUBLE - 3.0::DOUBLE AS court_x,
      ((event_id * 104729) % 5000)::DOUBLE / 100.0::DOUBLE - 3.0::DOUBLE AS court_y, value FROM events))"""
