"""Checks of stored data and what follows from them: broken constraints as rows or codes, eligibility of candidates, merges that cannot be.

Every check is a column expression, a window over its key or an equi-join; none fails a job: a caller counts or quarantines what is returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decisions import code_list

c = F.col


@dataclass(frozen=True)
class MergePolicy:
    """Fixed values of the validation of manual merges and of the selection of candidates."""

    shared_frames: int = 3
    shared_ratio: float = 0.10
    max_gap: float = 20.0
    max_speed: float = 25.0
    min_gap: float = 1 / 30
    in_court: float = 0.65
    movement_rate: float = 0.5
    fragments: int = 3
    base_in_court: float = 0.30
    duration: float = 1.0
    top: int = 4


def finite(*columns: str) -> Column:
    """Whether all the columns are numbers: neither null, NaN nor infinite."""
    ok = F.lit(True)
    for name in columns:
        ok &= c(name).isNotNull() & ~F.isnan(name) & (F.abs(c(name)) != float("inf"))
    return ok


def box_problems(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """Codes of a bounding box: NOT_FINITE alone, or the sides without an extent."""
    flat = code_list((c(x2) <= c(x1), "NO_WIDTH"), (c(y2) <= c(y1), "NO_HEIGHT"))
    return F.when(~finite(x1, y1, x2, y2), F.array(F.lit("NOT_FINITE"))).otherwise(flat)


def overlapping(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str], tolerance: float = 0) -> DataFrame:
    """Intervals that start before the one before them ends, with that end as `previous_end`; sorted by start, end and `tie`."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end, *tie))
    return df.withColumn("previous_end", before).where(c(start) < c("previous_end") - tolerance)


def not_increasing(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not above that of the row before them, with that value as `previous`."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))).where(c("previous") >= c(value))


def exclusion_reasons(p: MergePolicy = MergePolicy()) -> Column:
    """Why a candidate cannot be selected, in the order of the rules; columns quality, inside_ratio, movement_rate, fragments."""
    return code_list(
        (~F.coalesce(c("quality").isin("STRONG", "USABLE"), F.lit(False)), "uncertain_player_candidate"), (c("inside_ratio") < p.in_court, "mostly_outside_detected_court"),
        (c("movement_rate") < p.movement_rate, "limited_court_movement"), (c("fragments") > p.fragments, "excessive_track_fragmentation"),
    )


def reliable(p: MergePolicy = MergePolicy()) -> Column:
    """Whether a candidate is a reliable base of activity features; columns quality, inside_ratio, seconds, fragments."""
    return c("quality").isin("STRONG", "USABLE") & (c("inside_ratio") >= p.base_in_court) & (c("seconds") >= p.duration) & (c("fragments") <= p.fragments)


def stored_selection(candidates: DataFrame, keys: list[str], order: list[str], p: MergePolicy = MergePolicy()) -> DataFrame:
    """`reasons` and `eligible`: the first `top` candidates without a reason stay eligible, in stored order and not by rank."""
    rows = candidates.withColumn("reasons", exclusion_reasons(p))
    fit = (F.size("reasons") == 0).cast("long")
    place = F.sum(fit).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("eligible", (F.size("reasons") == 0) & (place <= p.top))
    late = (F.size("reasons") == 0) & ~c("eligible")
    return rows.withColumn("reasons", F.when(late, F.array(F.lit("outside_top_four_court_players"))).otherwise(c("reasons")))


def merge_problems(pairs: DataFrame, obs: DataFrame, p: MergePolicy = MergePolicy()) -> DataFrame:
    """(first_id, second_id, shared, problem) of pairs of groups; a null problem: the two can be merged.

    `pairs`: (first_id, second_id, first_side, second_side). `obs`: (group_id, frame_index, ts_us, court_x, court_y), one row for each observation. Shared frames are an equi-join
    of the pairs' distinct frames; ends and starts are aggregates of a group, so no group is held in memory.
    """
    frames = obs.select("group_id", "frame_index").distinct()
    at = lambda f, name: f(F.struct("court_x", "court_y"), F.struct("ts_us", "frame_index", "court_x", "court_y")).alias(name)
    ends = obs.groupBy("group_id").agg(F.count_distinct("frame_index").alias("n"), F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"), at(F.min_by, "from_at"), at(F.max_by, "to_at"))
    side = lambda name: ends.select(F.col("group_id").alias(f"{name}_id"), *[F.col(x).alias(f"{name}_{x}") for x in ("n", "from_us", "to_us", "from_at", "to_at")])
    keys = ["first_id", "second_id"]
    one = pairs.select(*keys).join(frames.withColumnRenamed("group_id", "first_id"), "first_id")
    shared = one.join(frames.withColumnRenamed("group_id", "second_id"), ["second_id", "frame_index"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"))
    rows = pairs.join(side("first"), "first_id", "left").join(side("second"), "second_id", "left").join(shared, keys, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    ahead = c("first_from_us") <= c("second_from_us")
    gap = F.when(ahead, c("second_from_us") - c("first_to_us")).otherwise(c("first_from_us") - c("second_to_us")) / 1_000_000
    a, b = F.when(ahead, c("first_to_at")).otherwise(c("second_to_at")), F.when(ahead, c("second_from_at")).otherwise(c("first_from_at"))
    way = F.sqrt(F.pow(a["court_x"] - b["court_x"], 2) + F.pow(a["court_y"] - b["court_y"], 2))
    rows = rows.withColumns({"gap": gap, "way": way})
    problem = (
        F.when((c("shared") >= p.shared_frames) | (c("shared") / F.greatest(F.lit(1), F.least("first_n", "second_n")) > p.shared_ratio), "SAME_TIME")
        .when(F.array_sort(F.array("first_side", "second_side")) == F.array(F.lit("FAR"), F.lit("NEAR")), "OPPOSITE_SIDES")
        .when(c("first_n").isNull() | c("second_n").isNull(), "NO_OBSERVATIONS").when(c("gap") < 0, "OVERLAP").when(c("gap") > p.max_gap, "LONG_GAP")
        .when(c("way") / F.greatest(c("gap"), F.lit(p.min_gap)) > p.max_speed, "IMPLAUSIBLE_SPEED")
    )
    return rows.select(*keys, "shared", problem.alias("problem"))


def combined_side(side: str) -> Column:
    """The one side a group is on, MIXED of several; UNKNOWN counts as none. An aggregate."""
    known = F.collect_set(F.when(c(side) != "UNKNOWN", c(side)))  # two sides at most
    return F.when(F.size(known) == 0, "UNKNOWN").when(F.size(known) > 1, "MIXED").otherwise(F.get(known, 0))


def artifact_readiness(state: str) -> Column:
    """The readiness of a set of artifacts, by the worst that decides. An aggregate; of no artifacts MISSING."""
    some = lambda value: F.coalesce(F.bool_or(c(state) == value), F.lit(False))
    gone = F.coalesce(F.every(c(state) == "MISSING"), F.lit(True))
    return F.when(gone, "MISSING").when(some("INCOMPATIBLE"), "INCOMPATIBLE").when(some("MISSING"), "PARTIAL").when(some("LEGACY"), "LEGACY").otherwise("READY")


def first_middle_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows 0, n // 2 and n - 1 of each key, each once."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"position": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "__n": F.count(F.lit(1)).over(w)})
    return rows.where((c("position") == 0) | (c("position") == F.floor(c("__n") / 2)) | (c("position") == c("__n") - 1)).drop("__n")


def repeated_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Members that are in more than one group, with the number of groups."""
    return df.select(group, member).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("groups")).where("groups > 1")


def in_first_order(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key its distinct values in the order in which they come first, and whether there is one at most. As long as a key's distinct values are few."""
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__first"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda x: x[value])
    return first.groupBy(*keys).agg(values.alias("values")).withColumn("single", F.size("values") <= 1)


def expired(df: DataFrame, folder: str, changed: str, size: str, cutoff: Column) -> DataFrame:
    """Folders whose newest file is older than `cutoff`, with their files and bytes."""
    return df.groupBy(folder).agg(F.max(changed).alias("newest"), F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes")).where(c("newest") < cutoff)


def attempts(runs: DataFrame, key: str, attempt: str, now: Column) -> DataFrame:
    """Per key the number of the next attempt and how many runs are stale: still processing when their lease has ended. Columns state, lease."""
    stale = (c("state") == "processing") & (c("lease") <= now)
    return runs.groupBy(key).agg((F.max(attempt) + 1).alias("next_attempt"), F.count_if(stale).alias("stale"))


def selected(candidates: DataFrame, keys: list[str], own: str, actions: DataFrame) -> DataFrame:
    """`candidates` (keys, own, eligible) after each key's actions: `status` EXCLUDED, SELECTED or PENDING.

    `actions`: (keys, own, action, number). Of a candidate the last REJECT or RESTORE decides; without one it is active if eligible, and RESTORE needs that too. The last SELECT of a key
    holds unless its candidate is rejected later or is not active.
    """
    last = lambda name: F.max_by("action", F.when(c("action").isin("REJECT", "RESTORE"), c("number"))).alias(name)
    rejected = F.max(F.when(c("action") == "REJECT", c("number"))).alias("rejected_at")
    own_actions = actions.groupBy(*keys, own).agg(last("moved"), rejected)
    chosen = actions.where("action = 'SELECT'").groupBy(*keys).agg(F.max(F.struct("number", own)).alias("chosen"))
    rows = candidates.join(own_actions, [*keys, own], "left").join(chosen, keys, "left")
    active = c("eligible") & ~c("moved").eqNullSafe("REJECT")
    picked = active & c("chosen")[own].eqNullSafe(c(own)) & (c("rejected_at").isNull() | (c("rejected_at") < c("chosen")["number"]))
    return rows.withColumn("status", F.when(~active, "EXCLUDED").when(picked, "SELECTED").otherwise("PENDING")).drop("moved", "rejected_at", "chosen")
