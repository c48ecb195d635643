"""Ordered-row primitives: deduplication, pairing, sessions, range means, islands and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedup_frames(obs: DataFrame, key: str = "player_id") -> DataFrame:
    """One observation per (key, frame): the most confident, then the smallest track."""
    return first_row(obs, [key, "frame_index"], [F.desc("confidence"), F.col("track_id")])


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds next_<column> of the following row of the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds prev_<column> of the preceding row of the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def sessions(df: DataFrame, keys: Sequence[str], at: str, max_gap: int, order: Sequence[str] = ()) -> DataFrame:
    """Adds `segment`, from 0 in each key: a new one where the gap to the row before exceeds max_gap."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    new = F.when(F.col(at) - F.lag(at).over(w) > max_gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def range_mean(df: DataFrame, keys: Sequence[str], at: str, half: int, columns: Sequence[str]) -> DataFrame:
    """Adds mean_<column> over the rows of the key within `half` of the row's place, both ends included."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-half, half)
    return df.withColumns({f"mean_{c}": F.avg(c).over(w) for c in columns})


def running(df: DataFrame, keys: Sequence[str], at: str, width: int, value: str, how, name: str) -> DataFrame:
    """Adds `name`: `how` (F.max or F.sum) of `value` over the rows of the key before this one; null where there are none.

    Rows are looked at in blocks of `width` units of `at`, and each block gets the result of those before it, so a key with many rows is no single task.
    """
    df = df.withColumn("__block", F.floor(F.col(at) / width))
    upto = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "__block").agg(how(value).alias("__sum")).select(*keys, "__block", how("__sum").over(upto).alias("__carry"))
    inner = how(value).over(Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    both = F.coalesce(F.col("__inner") + F.col("__carry"), "__inner", "__carry") if how is F.sum else F.greatest("__inner", "__carry")
    return df.withColumn("__inner", inner).join(blocks, [*keys, "__block"]).withColumn(name, both).drop("__block", "__inner", "__carry")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals of a key merged where they overlap or touch: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    out = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def concurrency(df: DataFrame, keys: Sequence[str], start: str, end: str, least: int) -> DataFrame:
    """Per key the length of time in which at least `least` intervals are open. Ends come before starts at the same time."""
    edge = lambda column, step: df.select(*keys, F.col(column).alias("__at"), F.lit(step).alias("__step"))
    edges = edge(start, 1).unionByName(edge(end, -1)).groupBy(*keys, "__at").agg(F.sum("__step").alias("__step"))
    w = Window.partitionBy(*keys).orderBy("__at")
    open_now = F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = edges.withColumn("__open", open_now).withColumn("__until", F.lead("__at").over(w))
    return spans.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("__open") >= least, F.col("__until") - F.col("__at"))), F.lit(0)).alias("length"))


def clipped(df: DataFrame, start: str, end: str, width: int, extent: str | None = None) -> DataFrame:
    """Intervals cut at the tumbling windows they meet: `win`, clip_start, clip_end. A range join written as an explode, so it stays an equi-join."""
    last = (F.col(end) - 1) / width
    df = df.where(F.col(end) > F.col(start)).withColumn("win", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last))))
    return df.withColumns({"clip_start": F.greatest(F.col(start), F.col("win") * width), "clip_end": F.least(F.col(end), (F.col("win") + 1) * width)})


def upper_median(column: Column) -> Column:
    """The element at n // 2 of the sorted values (not the mean of the middle two)."""
    values = F.array_sort(F.collect_list(column))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))
