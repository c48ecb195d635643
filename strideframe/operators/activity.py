"""Motion features of tumbling windows, window states, and intervals of equal state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.policy import ActivityPolicy, Court
from . import windows as W
from .decisions import ordinal_least

KEYS = ["analysis_id", "player_id", "track_id"]


def velocities(obs: DataFrame, rule: ActivityPolicy) -> DataFrame:
    """Per pair of smoothed in-court points of a track: start, end, speed, the change of speed and the turn against the pair before."""
    points = W.sessions(obs.where("inside"), ["track_id"], "ts_us", rule.max_gap_us, ["frame_index"])
    points = W.range_mean(points, [*KEYS, "segment"], "ts_us", rule.half_smoothing_us, ["court_x", "court_y"])
    v = W.with_previous(points, KEYS, ["ts_us", "frame_index"], ["ts_us", "mean_court_x", "mean_court_y"])
    v = v.withColumn("dt", F.col("ts_us") - F.col("prev_ts_us")).where(F.col("dt").between(rule.min_dt_us, rule.max_gap_us))
    s = G.seconds(F.col("dt"))
    v = v.withColumns({"vx": (F.col("mean_court_x") - F.col("prev_mean_court_x")) / s, "vy": (F.col("mean_court_y") - F.col("prev_mean_court_y")) / s})
    v = v.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    v = _with_turns(v, rule)
    return v.select(*KEYS, "frame_index", F.col("prev_ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), "speed", "speed_change", "turn")


def _with_turns(v: DataFrame, rule: ActivityPolicy) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("ts_us", "frame_index")
    v = v.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("ts_us", "speed", "vx", "vy")})
    dt = F.col("ts_us") - F.col("last_ts_us")
    change = F.when(dt.between(rule.min_dt_us, rule.max_gap_us), F.abs(F.col("speed") - F.col("last_speed")) / G.seconds(dt))
    angle = G.angle_degrees(F.col("last_vx"), F.col("last_vy"), F.col("vx"), F.col("vy"))
    turn = (F.col("speed") >= rule.direction_speed) & (F.col("last_speed") >= rule.direction_speed) & (angle >= rule.direction_degrees)
    return v.withColumns({"speed_change": change, "turn": F.coalesce(turn, F.lit(False))})


def observed_islands(obs: DataFrame, rule: ActivityPolicy) -> DataFrame:
    """Per player the merged intervals between in-court neighbours of one track within the gap limit."""
    pairs = W.with_next(obs.where("inside"), ["analysis_id", "player_id"], ["ts_us", "frame_index", "track_id"], ["ts_us", "track_id"])
    gap = F.col("next_ts_us") - F.col("ts_us")
    pairs = pairs.where((F.col("next_track_id") == F.col("track_id")) & (gap > 0) & (gap <= rule.max_gap_us))
    pairs = pairs.select("analysis_id", "player_id", F.col("ts_us").alias("start_us"), F.col("next_ts_us").alias("end_us"))
    return W.islands(pairs, ["analysis_id", "player_id"], "start_us", "end_us")


def window_features(obs: DataFrame, rule: ActivityPolicy, court: Court | None = None) -> DataFrame:
    """One row per analysis and window with observations: reliable players, shares, speeds, turns and their states' inputs.

    With a `court` also `kitchen_players`: reliable players that stand still and have at least half of their in-court rows of the window in the kitchen."""
    width = rule.window_us
    clips = W.clipped(observed_islands(obs, rule), "start_us", "end_us", width)
    cover = clips.groupBy("analysis_id", "player_id", "win").agg(F.sum(F.col("clip_end") - F.col("clip_start")).alias("cover_us"))
    reliable = cover.where(F.col("cover_us") >= rule.coverage * width)
    keys = ["analysis_id", "player_id", "win"]
    own = clips.join(reliable.select(*keys), keys, "left_semi")
    together = W.concurrency(own, ["analysis_id", "win"], "clip_start", "clip_end", rule.min_players).withColumnRenamed("length", "observed_us")
    v = W.clipped(velocities(obs, rule), "start_us", "end_us", width).withColumn("overlap", F.col("clip_end") - F.col("clip_start"))
    v = v.join(reliable.select(*keys), keys, "left_semi")
    in_end = (F.col("end_us") >= F.col("win") * width) & (F.col("end_us") < (F.col("win") + 1) * width)
    players = v.groupBy(*keys).agg(
        F.sum("overlap").alias("overlap"),
        F.sum(F.col("speed") * F.col("overlap")).alias("weighted"),
        F.sum(F.when(F.col("speed") >= rule.moving_speed, F.col("overlap")).otherwise(0)).alias("moving_us"),
        F.sum(F.when(F.col("speed") <= rule.stationary_speed, F.col("overlap")).otherwise(0)).alias("stationary_us"),
        F.count_if(in_end & F.col("turn")).alias("turns"),
        F.sum(F.when(in_end, F.col("speed_change"))).alias("change_sum"),
        F.count(F.when(in_end, F.col("speed_change"))).alias("change_n"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("overlap", "moving_us", "stationary_us", "turns", "change_n")}
    players = reliable.join(players, keys, "left").withColumns(zero)
    kitchen = []
    if court:
        seen = obs.where("inside").groupBy("analysis_id", "player_id", F.floor(F.col("ts_us") / width).alias("win"))
        share = F.avg((G.zone(F.col("court_y"), court) == "kitchen").cast("int"))
        players = players.join(seen.agg(share.alias("kitchen_share")), keys, "left")
        kitchen = [F.count_if((F.col("stationary_us") >= rule.idle_stationary * width) & (F.col("kitchen_share") >= 0.5)).alias("kitchen_players")]
    parts = obs.groupBy("analysis_id", "player_id", F.floor(F.col("ts_us") / width).alias("win")).agg(F.count_distinct("track_id").alias("parts"))
    players = players.join(parts, keys, "left")
    moving = v.where(F.col("speed") >= rule.moving_speed)
    both = W.concurrency(moving, ["analysis_id", "win"], "clip_start", "clip_end", rule.min_players).withColumnRenamed("length", "simultaneous_us")
    out = players.groupBy("analysis_id", "win").agg(
        F.count(F.lit(1)).alias("reliable_players"),
        F.sum("cover_us").alias("cover_us"),
        F.try_divide(F.sum("weighted"), F.sum("overlap")).alias("speed"),
        F.count_if(F.col("moving_us") >= rule.min_moving_share * width).alias("moving_players"),
        F.avg("stationary_us").alias("stationary_us"),
        F.sum("turns").alias("turns"),
        F.try_divide(F.sum("change_sum"), F.sum("change_n")).alias("speed_change"),
        F.max("parts").alias("fragments"),
        *kitchen,
    )
    out = out.join(together, ["analysis_id", "win"], "left").join(both, ["analysis_id", "win"], "left")
    visible = obs.select("analysis_id", "player_id", F.floor(F.col("ts_us") / width).alias("win")).groupBy("analysis_id", "win").agg(F.count_distinct("player_id").alias("visible_players"))
    out = visible.join(out, ["analysis_id", "win"], "left")
    speed = F.coalesce("speed", F.lit(0.0))
    return out.select(
        "analysis_id",
        "win",
        "visible_players",
        F.coalesce("reliable_players", F.lit(0)).alias("reliable_players"),
        (F.coalesce("observed_us", F.lit(0)) / width).alias("coverage"),
        speed.alias("speed"),
        F.least(F.lit(1.0), speed / rule.reference_speed).alias("intensity"),
        F.coalesce("speed_change", F.lit(0.0)).alias("speed_change"),
        F.coalesce(F.try_divide(F.col("turns"), G.seconds(F.col("cover_us"))), F.lit(0.0)).alias("turn_rate"),
        F.coalesce("moving_players", F.lit(0)).alias("moving_players"),
        F.coalesce("simultaneous_us", F.lit(0)).alias("simultaneous_us"),
        (F.coalesce("stationary_us", F.lit(0.0)) / width).alias("stationary_share"),
        F.coalesce("fragments", F.lit(0)).alias("fragments"),
        *([F.coalesce("kitchen_players", F.lit(0)).alias("kitchen_players")] if court else []),
    )


def classifier_inputs(features: DataFrame, obs: DataFrame, rule: ActivityPolicy) -> DataFrame:
    """The features of windows (made with a court) as inputs of the full classifier; nothing is known of the recording, and the sources are current."""
    length = obs.groupBy("analysis_id").agg(G.seconds(F.max("ts_us") - F.min("ts_us")).alias("source_seconds"))
    window = F.lit(rule.window_us / 1_000_000)
    return features.join(length, "analysis_id").select(
        "analysis_id",
        "win",
        F.col("visible_players").alias("visible"),
        F.col("reliable_players").alias("reliable"),
        "fragments",
        "coverage",
        (1 - F.col("coverage")).alias("gap_ratio"),
        window.alias("window_seconds"),
        "source_seconds",
        F.lit(None).cast("string").alias("quality"),
        F.lit(True).alias("current"),
        F.col("moving_players").alias("moving"),
        (F.col("simultaneous_us") >= rule.min_simultaneous_share * rule.window_us).alias("simultaneous"),
        "intensity",
        F.col("kitchen_players").alias("kitchen"),
        (F.col("stationary_share") * window).alias("stationary_seconds"),
        F.col("turn_rate").alias("direction_rate"),
        "speed",
        "speed_change",
        G.seconds(F.col("simultaneous_us")).alias("simultaneous_seconds"),
    )


def classified_intervals(windows: DataFrame) -> DataFrame:
    """Runs of neighbouring classified windows of one state: weakest confidence, visibility and continuity, worst gap, means weighted by length, sums, and all codes."""
    w = Window.partitionBy("analysis_id").orderBy("win")
    new = F.when((F.lag("state").over(w) == F.col("state")) & (F.col("win") - F.lag("win").over(w) == 1), 0).otherwise(1)
    rows = windows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seconds = F.col("window_seconds")
    mean = lambda c: (F.sum(F.col(c) * seconds) / F.sum(seconds)).alias(c)
    levels = ["NOT_AVAILABLE", "LOW", "MODERATE", "HIGH"]
    out = rows.groupBy("analysis_id", "__run").agg(
        F.min("state").alias("state"),
        F.min("win").alias("first_win"),
        F.max("win").alias("last_win"),
        F.count(F.lit(1)).alias("windows"),
        (F.sum(F.col("coverage") * seconds) / F.sum(seconds)).alias("observed_ratio"),
        F.min("visible").alias("visible"),
        F.min("reliable").alias("reliable"),
        F.min("moving").alias("moving"),
        F.max("kitchen").alias("kitchen"),
        F.bool_and("simultaneous").alias("simultaneous"),
        F.sum("simultaneous_seconds").alias("simultaneous_seconds"),
        F.sum("stationary_seconds").alias("stationary_seconds"),
        *map(mean, ("speed", "speed_change", "intensity", "direction_rate")),
        ordinal_least(F.col("confidence"), levels).alias("confidence"),
        ordinal_least(F.col("visibility"), levels).alias("visibility"),
        ordinal_least(F.col("continuity"), ["NOT_AVAILABLE", "POOR", "LIMITED", "STRONG"]).alias("continuity"),
        ordinal_least(F.col("gap_severity"), ["SEVERE", "MINOR", "NONE"]).alias("gap_severity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reason_codes")))).alias("reason_codes"),  # sets of few codes
    )
    return out.drop("__run")


def window_states(features: DataFrame, rule: ActivityPolicy, coverage: float = 0.3) -> DataFrame:
    """ACTIVE, IDLE or UNKNOWN with the reasons that decided. Where the features count `kitchen_players`, a window with one is not IDLE."""
    c = F.col
    kitchen = c("kitchen_players") > 0 if "kitchen_players" in features.columns else F.lit(False)
    gate = (c("reliable_players") < rule.min_players) | (c("coverage") < coverage)
    active = (c("moving_players") >= 2) & (c("simultaneous_us") >= rule.min_simultaneous_share * rule.window_us) & (c("intensity") >= rule.active_intensity)
    idle = (c("moving_players") == 0) & ~kitchen & (c("intensity") <= rule.idle_intensity) & (c("stationary_share") >= rule.idle_stationary)
    state = F.when(gate, "UNKNOWN").when(active, "ACTIVE").when(idle, "IDLE").otherwise("UNKNOWN")
    reason = F.when(c("reliable_players") < rule.min_players, "FEW_PLAYERS").when(c("coverage") < coverage, "LOW_COVERAGE").when(active, "MOVING_TOGETHER").when(idle, "STATIONARY").when(kitchen, "CONFLICTING_EVIDENCE,KITCHEN_LOW_MOVEMENT_SAFEGUARD").otherwise("CONFLICTING_EVIDENCE")
    gap = 1 - c("coverage")
    severity = F.when(gap >= rule.severe_gap, "SEVERE").when(gap >= rule.minor_gap, "MINOR").otherwise("NONE")
    return features.withColumns({"state": state, "reason": reason, "gap_severity": severity})


def state_intervals(states: DataFrame, rule: ActivityPolicy) -> DataFrame:
    """Runs of neighbouring windows of equal state, with what their windows add up to."""
    w = Window.partitionBy("analysis_id").orderBy("win")
    new = F.when((F.lag("state").over(w) == F.col("state")) & (F.col("win") - F.lag("win").over(w) == 1), 0).otherwise(1)
    rows = states.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(F.col("gap_severity") == "SEVERE", 2).when(F.col("gap_severity") == "MINOR", 1).otherwise(0)
    out = rows.groupBy("analysis_id", "__island").agg(
        F.min("state").alias("state"),
        F.min("win").alias("first_win"),
        F.max("win").alias("last_win"),
        F.count(F.lit(1)).alias("windows"),
        F.min("reliable_players").alias("reliable_players"),
        F.min("moving_players").alias("moving_players"),
        F.sum("simultaneous_us").alias("simultaneous_us"),
        F.avg("intensity").alias("intensity"),
        F.max_by("gap_severity", rank).alias("gap_severity"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("reason", ","))))), ",").alias("reasons"),
        *([F.max("kitchen_players").alias("kitchen_players")] if "kitchen_players" in states.columns else []),
    )
    return out.drop("__island")
