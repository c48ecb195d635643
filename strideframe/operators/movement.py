"""Distances, durations and zone dwell of a player's timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.policy import Court, MovementPolicy
from .windows import dedup_frames, with_next

ORDER = ["ts_us", "frame_index", "track_id"]


def _pair(policy: MovementPolicy, zero: bool = False) -> Column:
    """Whether a row and the next belong together: same track, a gap above 0 (or from 0) and within the limit."""
    gap = F.col("next_ts_us") - F.col("ts_us")
    return (F.col("next_track_id") == F.col("track_id")) & ((gap >= 0) if zero else (gap > 0)) & (gap <= policy.max_gap_us)


def _step() -> Column:
    return G.distance(F.col("court_x"), F.col("court_y"), F.col("next_court_x"), F.col("next_court_y"))


def _next(df: DataFrame, key: str) -> DataFrame:
    return with_next(df, [key], ORDER, ["ts_us", "track_id", "court_x", "court_y", "inside"])


def observed_path(obs: DataFrame, policy: MovementPolicy, key: str = "player_id") -> DataFrame:
    """Path over consecutive in-court rows (filtered before pairing) of one track within the gap limit."""
    pairs = _next(obs.where("inside"), key)
    return pairs.groupBy(key).agg(F.coalesce(F.sum(F.when(_pair(policy), _step())), F.lit(0.0)).alias("observed_path"))


def plain_path(obs: DataFrame, key: str = "player_id") -> DataFrame:
    """Path over all consecutive in-court rows, whatever lies between them."""
    return _next(obs.where("inside"), key).groupBy(key).agg(F.coalesce(F.sum(_step()), F.lit(0.0)).alias("plain_path"))


def track_path(obs: DataFrame, policy: MovementPolicy, key: str = "player_id") -> DataFrame:
    """Per track, in-court rows without a gap limit, steps within the limit; summed over the key's tracks."""
    pairs = with_next(obs.where("inside"), [key, "track_id"], ["ts_us", "frame_index"], ["court_x", "court_y"])
    return pairs.groupBy(key).agg(F.coalesce(F.sum(F.when(_step() <= policy.max_step, _step())), F.lit(0.0)).alias("track_path"))


def fragment_path(obs: DataFrame, policy: MovementPolicy, key: str = "player_id") -> DataFrame:
    """Per track over all rows: both ends in court, a gap within the limit and a step within the limit."""
    pairs = with_next(obs, [key, "track_id"], ["ts_us", "frame_index"], ["ts_us", "court_x", "court_y", "inside"])
    gap = F.col("next_ts_us") - F.col("ts_us")
    ok = F.col("inside") & F.col("next_inside") & (gap > 0) & (gap <= policy.max_gap_us) & (_step() <= policy.max_step)
    return pairs.groupBy(key).agg(F.coalesce(F.sum(F.when(ok, _step())), F.lit(0.0)).alias("fragment_path"))


def durations(obs: DataFrame, policy: MovementPolicy, key: str = "player_id") -> DataFrame:
    """Observed seconds (gaps within the limit in one track, over all rows), the span, and what of it is unobserved."""
    gap = F.col("next_ts_us") - F.col("ts_us")
    out = _next(obs, key).groupBy(key).agg(
        F.coalesce(F.sum(F.when(_pair(policy), gap)), F.lit(0)).alias("observed_us"), (F.max("ts_us") - F.min("ts_us")).alias("span_us")
    )
    return out.select(
        key,
        G.seconds(F.col("observed_us")).alias("observed_seconds"),
        G.seconds(F.greatest(F.lit(0), F.col("span_us") - F.col("observed_us"))).alias("unobserved_seconds"),
    )


def zone_dwell(obs: DataFrame, policy: MovementPolicy, court: Court, key: str = "player_id") -> DataFrame:
    """Seconds and percentage of tracked time by the zone of the earlier row of each in-court pair."""
    pairs = _next(obs.where("inside"), key).withColumn("zone", G.zone(F.col("court_y"), court))
    gap = F.when(_pair(policy, zero=True), F.col("next_ts_us") - F.col("ts_us"))
    sums = [F.coalesce(F.sum(F.when(F.col("zone") == z, gap)), F.lit(0)).alias(z) for z in ("kitchen", "transition", "baseline")]
    out = pairs.groupBy(key).agg(*sums)
    total = F.col("kitchen") + F.col("transition") + F.col("baseline")
    shares = [F.coalesce(F.try_divide(F.col(z), total) * 100, F.lit(0.0)).alias(f"{z}_percent") for z in ("kitchen", "transition", "baseline")]
    return out.select(key, *[G.seconds(F.col(z)).alias(f"{z}_seconds") for z in ("kitchen", "transition", "baseline")], *shares, G.seconds(total).alias("tracked_seconds"))


def movement_summary(obs: DataFrame, policy: MovementPolicy, court: Court, key: str = "player_id") -> DataFrame:
    """One row per player, in one shuffle: counts, distances, durations, mean position and zone shares.

    Of several detections in a frame the best one counts. In-court pairing needs the next in-court row and duration pairing the next row of any kind: both
    are windows over one partitioning and order, latest row first, so that the frame of the in-court one grows and each row costs the same.
    """
    rows = dedup_frames(obs.repartition(key), key)  # one shuffle serves both windows
    w = Window.partitionBy(key).orderBy(*[F.desc(x) for x in ORDER])
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(*["ts_us", "track_id", "court_x", "court_y"])
    rows = rows.withColumns({"n": F.lag(row).over(w), "c": F.last(F.when(F.col("inside"), row), ignorenulls=True).over(ahead)})
    gap = F.col("n.ts_us") - F.col("ts_us")
    near = (F.col("n.track_id") == F.col("track_id")) & (gap > 0) & (gap <= policy.max_gap_us)
    court_gap = F.col("c.ts_us") - F.col("ts_us")
    together = F.col("inside") & (F.col("c.track_id") == F.col("track_id")) & (court_gap >= 0) & (court_gap <= policy.max_gap_us)
    step = G.distance(F.col("court_x"), F.col("court_y"), F.col("c.court_x"), F.col("c.court_y"))
    zone = G.zone(F.col("court_y"), court)
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if("inside").alias("in_court"),
        F.coalesce(F.sum(F.when(near, gap)), F.lit(0)).alias("observed_us"),
        (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
        F.coalesce(F.sum(F.when(together & (court_gap > 0), step)), F.lit(0.0)).alias("feet"),
        F.avg(F.when(F.col("inside"), F.col("court_x"))).alias("mean_x"),
        F.avg(F.when(F.col("inside"), F.col("court_y"))).alias("mean_y"),
        *[F.coalesce(F.sum(F.when(together & (zone == z), court_gap)), F.lit(0)).alias(z) for z in ("kitchen", "transition", "baseline")],
    )
    total = F.col("kitchen") + F.col("transition") + F.col("baseline")
    observed = G.seconds(F.col("observed_us"))
    return out.select(
        key,
        "observations",
        "in_court",
        F.round(observed, 6).alias("observed_seconds"),
        F.round(G.seconds(F.greatest(F.lit(0), F.col("span_us") - F.col("observed_us"))), 6).alias("unobserved_seconds"),
        F.round("feet", 6).alias("distance_feet"),
        F.round(F.col("feet") * policy.feet_to_metres, 6).alias("distance_metres"),
        F.round(G.ratio_or_zero(F.col("feet"), observed), 9).alias("feet_per_second"),
        F.round("mean_x", 9).alias("mean_x"),
        F.round("mean_y", 9).alias("mean_y"),
        *[F.round(F.coalesce(F.try_divide(F.col(z), total) * 100, F.lit(0.0)), 6).alias(f"{z}_percent") for z in ("kitchen", "transition", "baseline")],
    )
