"""Figures of dashboards: counts over fixed classes, coverage, bar widths, overall states. One aggregation each, or a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: Fixed values.
SPLITS = ("development", "validation", "holdout")
REVIEWS = ("reviewed", "partially_reviewed", "not_reviewed")
READINESS = ("READY", "PARTIAL", "LEGACY", "MISSING", "INCOMPATIBLE")
COMPLETED = ("READY", "LIMITED", "UNSUITABLE")
STATES = ("CURRENT", "STALE", "MISSING", "INVALID")
BAR_LEAST = 3.0


def dataset_overview(samples: DataFrame, split: str, review: str) -> DataFrame:
    """One row: samples in all, by split and by state of review."""
    one = lambda column, value: F.count_if(c(column) == value).alias(value)
    return samples.agg(F.count(F.lit(1)).alias("samples"), *[one(split, s) for s in SPLITS], *[one(review, r) for r in REVIEWS])


def class_counts(rows: DataFrame, column: str, key: str, classes: tuple[str, ...] = READINESS) -> DataFrame:
    """Every class, also without rows, with the number of its rows and their least and greatest key."""
    dense = rows.sparkSession.createDataFrame([(name,) for name in classes], f"{column} string")
    held = rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    return dense.join(held, column, "left").select(column, F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last")


def overall_status(status: str) -> Column:
    """Aggregate: the worst of the states, CURRENT without any."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), c(status))
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), F.coalesce(F.nullif(F.max(rank), F.lit(0)), F.lit(1)).cast("int"))


def storage_totals(files: DataFrame, key: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(one row of files and bytes, keys that more than one file has)."""
    totals = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return totals, files.groupBy(key).agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def coverage(observed: str, total: str) -> tuple[Column, Column]:
    """(observed percentage, uncertain seconds); null unless 0 < observed <= total."""
    valid = (c(observed) > 0) & (c(total) > 0) & (c(observed) <= c(total))
    return F.when(valid, c(observed) / c(total) * 100), F.when(valid, c(total) - c(observed))


def bar_width(value: str, others: tuple[str, ...], percent: Column) -> Column:
    """Width in percent: of 100 for percentages, else of 1.1 times the greatest of `others`; visible from BAR_LEAST on if above 0."""
    greatest = F.greatest(*[c(o) for o in others], F.lit(2.0**-52)) if len(others) > 1 else F.greatest(c(others[0]), F.lit(2.0**-52))
    share = c(value) / F.when(percent, 100.0).otherwise(greatest * 1.1) * 100
    return F.greatest(F.when(c(value) > 0, BAR_LEAST).otherwise(0.0), F.least(F.lit(100.0), share))


def completed(rows: DataFrame, keys: list[str], status: str, newest: list[str], item: str) -> DataFrame:
    """Per key the number of completed items and the newest of them."""
    done = c(status).isin(*COMPLETED)
    newest_item = F.max(F.when(done, F.struct(*newest, item)))[item]
    return rows.groupBy(*keys).agg(F.count_if(done).alias("completed"), newest_item.alias("latest"))


def legacy_summary(inventory: DataFrame) -> DataFrame:
    """Classes of folders with their number, artifacts and bytes."""
    return inventory.groupBy("classification").agg(F.count(F.lit(1)).alias("folders"), F.sum("artifacts").alias("artifacts"), F.sum("size_bytes").alias("size_bytes"))
