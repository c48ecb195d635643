"""Queries over the movement timeline, each with the DuckDB statement that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import movement as M
from ..operators import tracks as T
from ..operators import windows as W
from ..sources.observations import OBS_SQL, observations
from .policy import EVENT_MOVEMENT, Court, Eligibility

COURT, POLICY = Court(), EVENT_MOVEMENT
#: A plausible image-to-court matrix for the projection query.
MATRIX = ((0.9, 0.05, 1.5), (0.02, 1.1, -2.0), (0.0005, 0.001, 1.0))


def movement_summary(spark, sf_dir):
    return M.movement_summary(observations(spark, sf_dir), POLICY, COURT)


_NEXT = """
p AS (SELECT *, lead(ts_us) OVER w AS nt, lead(track_id) OVER w AS nk FROM obs WINDOW w AS (PARTITION BY player_id ORDER BY ts_us, frame_index, track_id)),
c AS (SELECT *, lead(ts_us) OVER w AS nt, lead(track_id) OVER w AS nk, lead(court_x) OVER w AS nx, lead(court_y) OVER w AS ny,
    CASE WHEN abs(court_y - 22) <= 7 THEN 'kitchen' WHEN abs(court_y - 22) <= 15 THEN 'transition' ELSE 'baseline' END AS zone
  FROM obs WHERE inside WINDOW w AS (PARTITION BY player_id ORDER BY ts_us, frame_index, track_id)),
c2 AS (SELECT *, nk = track_id AND nt - ts_us BETWEEN 0 AND 21600000000 AS near, sqrt((nx - court_x) * (nx - court_x) + (ny - court_y) * (ny - court_y)) AS step FROM c)"""

MOVEMENT_SQL = f"""
WITH {OBS_SQL}, {_NEXT},
d AS (SELECT player_id, count(*) AS observations, count(*) FILTER (inside) AS in_court,
    coalesce(sum(CASE WHEN nk = track_id AND nt - ts_us > 0 AND nt - ts_us <= 21600000000 THEN nt - ts_us END), 0)::BIGINT AS o, max(ts_us) - min(ts_us) AS span
  FROM p GROUP BY 1),
e AS (SELECT player_id, coalesce(sum(step) FILTER (near AND nt > ts_us), 0) AS feet, avg(court_x) AS mx, avg(court_y) AS my,
    coalesce(sum(nt - ts_us) FILTER (near AND zone = 'kitchen'), 0)::DOUBLE AS k, coalesce(sum(nt - ts_us) FILTER (near AND zone = 'transition'), 0)::DOUBLE AS t,
    coalesce(sum(nt - ts_us) FILTER (near AND zone = 'baseline'), 0)::DOUBLE AS b FROM c2 GROUP BY 1)
SELECT d.player_id, observations, in_court, round(o / 1000000.0::DOUBLE, 6) AS observed_seconds,
  round(greatest(0, span - o) / 1000000.0::DOUBLE, 6) AS unobserved_seconds, round(coalesce(feet, 0), 6) AS distance_feet,
  round(coalesce(feet, 0) * 0.3048::DOUBLE, 6) AS distance_metres, round(coalesce(feet / nullif(o / 1000000.0::DOUBLE, 0), 0), 9) AS feet_per_second,
  round(mx, 9) AS mean_x, round(my, 9) AS mean_y, round(coalesce(k / nullif(k + t + b, 0) * 100, 0), 6) AS kitchen_percent,
  round(coalesce(t / nullif(k + t + b, 0) * 100, 0), 6) AS transition_percent, round(coalesce(b / nullif(k + t + b, 0) * 100, 0), 6) AS baseline_percent
FROM d LEFT JOIN e USING (player_id)
"""


def obs_projection(spark, sf_dir):
    x, y = G.homography(F.col("court_x"), F.col("court_y"), MATRIX)
    df = observations(spark, sf_dir).select("frame_index", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    return df.select("*", G.inside(F.col("x"), F.col("y"), COURT).alias("inside"), G.inside(F.col("x"), F.col("y"), COURT, 3.0).alias("extended"))


PROJECTION_SQL = f"""
WITH {OBS_SQL},
w AS (SELECT frame_index, 0.9::DOUBLE * court_x + 0.05::DOUBLE * court_y + 1.5::DOUBLE AS a, 0.02::DOUBLE * court_x + 1.1::DOUBLE * court_y - 2.0::DOUBLE AS b,
    0.0005::DOUBLE * court_x + 0.001::DOUBLE * court_y + 1.0::DOUBLE AS w FROM obs),
q AS (SELECT frame_index, round(a / w, 6) AS x, round(b / w, 6) AS y FROM w WHERE abs(w) > 1e-12)
SELECT *, x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 44 AS inside, x BETWEEN -3 AND 23 AND y BETWEEN -3 AND 47 AS extended FROM q
"""


def zone_dwell(spark, sf_dir):
    df = M.zone_dwell(observations(spark, sf_dir), POLICY, COURT)
    return df.select("player_id", *[F.round(c, 6).alias(c) for c in df.columns[1:]])


ZONE_SQL = f"""
WITH {OBS_SQL}, {_NEXT},
s AS (SELECT player_id, coalesce(sum(nt - ts_us) FILTER (near AND zone = 'kitchen'), 0)::DOUBLE AS k, coalesce(sum(nt - ts_us) FILTER (near AND zone = 'transition'), 0)::DOUBLE AS t,
    coalesce(sum(nt - ts_us) FILTER (near AND zone = 'baseline'), 0)::DOUBLE AS b FROM c2 GROUP BY 1)
SELECT player_id, round(k / 1e6, 6) AS kitchen_seconds, round(t / 1e6, 6) AS transition_seconds, round(b / 1e6, 6) AS baseline_seconds,
  round(coalesce(k / nullif(k + t + b, 0) * 100, 0), 6) AS kitchen_percent, round(coalesce(t / nullif(k + t + b, 0) * 100, 0), 6) AS transition_percent,
  round(coalesce(b / nullif(k + t + b, 0) * 100, 0), 6) AS baseline_percent, round((k + t + b) / 1e6, 6) AS tracked_seconds FROM s
"""


def frame_dedup(spark, sf_dir):
    """Frames of ten minutes: one observation per player and frame."""
    obs = observations(spark, sf_dir).withColumn("slot", F.expr("ts_us div 600000000"))
    out = W.first_row(obs, ["analysis_id", "slot"], [F.desc("confidence"), F.col("track_id"), F.col("frame_index")])
    return out.select("analysis_id", "slot", "frame_index", "track_id", "confidence")


DEDUP_SQL = f"""
WITH {OBS_SQL}, s AS (SELECT *, ts_us // 600000000 AS slot FROM obs)
SELECT analysis_id, slot, frame_index, track_id, confidence FROM s
QUALIFY row_number() OVER (PARTITION BY analysis_id, slot ORDER BY confidence DESC, track_id, frame_index) = 1
"""


def path_length_variants(spark, sf_dir):
    obs = observations(spark, sf_dir)
    out = obs.select("player_id").distinct()
    for part in (M.observed_path(obs, POLICY), M.plain_path(obs), M.track_path(obs, POLICY), M.fragment_path(obs, POLICY)):
        out = out.join(part, "player_id", "left")
    return out.select("player_id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("observed_path", "plain_path", "track_path", "fragment_path")])


PATHS_SQL = f"""
WITH {OBS_SQL}, {_NEXT},
a AS (SELECT player_id, sum(step) FILTER (near AND nt > ts_us) AS observed_path, sum(step) AS plain_path FROM c2 GROUP BY 1),
k AS (SELECT player_id, lead(court_x) OVER w AS nx, lead(court_y) OVER w AS ny, court_x, court_y FROM obs WHERE inside
  WINDOW w AS (PARTITION BY player_id, track_id ORDER BY ts_us, frame_index)),
k2 AS (SELECT player_id, sqrt((nx - court_x) * (nx - court_x) + (ny - court_y) * (ny - court_y)) AS step FROM k),
b AS (SELECT player_id, sum(step) FILTER (step <= 15) AS track_path FROM k2 GROUP BY 1),
f AS (SELECT player_id, inside AND lead(inside) OVER w AS ok, lead(ts_us) OVER w - ts_us AS gap, lead(court_x) OVER w AS nx, lead(court_y) OVER w AS ny, court_x, court_y FROM obs
  WINDOW w AS (PARTITION BY player_id, track_id ORDER BY ts_us, frame_index)),
f2 AS (SELECT *, sqrt((nx - court_x) * (nx - court_x) + (ny - court_y) * (ny - court_y)) AS step FROM f),
g AS (SELECT player_id, sum(step) FILTER (ok AND gap > 0 AND gap <= 21600000000 AND step <= 15) AS fragment_path FROM f2 GROUP BY 1)
SELECT player_id, round(coalesce(observed_path, 0), 6) AS observed_path, round(coalesce(plain_path, 0), 6) AS plain_path, round(coalesce(track_path, 0), 6) AS track_path,
  round(coalesce(fragment_path, 0), 6) AS fragment_path
FROM (SELECT DISTINCT player_id FROM obs) LEFT JOIN a USING (player_id) LEFT JOIN b USING (player_id) LEFT JOIN g USING (player_id)
"""


def track_summary(spark, sf_dir):
    return T.track_summary(observations(spark, sf_dir), Eligibility(duration=86_400.0, rate=0.00012, inside_ratio=0.6, extended_ratio=0.7, confidence=0.45))


_TRACKS = """
s AS (SELECT *, lag(court_x) OVER w AS lx, lag(court_y) OVER w AS ly FROM obs WHERE inside WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, frame_index)),
s2 AS (SELECT track_id, sqrt((lx - court_x) * (lx - court_x) + (ly - court_y) * (ly - court_y)) AS step FROM s),
d AS (SELECT track_id, coalesce(sum(step) FILTER (step <= 15), 0) AS feet FROM s2 GROUP BY 1),
a AS (SELECT track_id, min(player_id) AS player_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS duration,
    count(*) AS observations, avg(confidence) AS confidence, count(*) FILTER (inside) / count(*)::DOUBLE AS inside_ratio, count(*) FILTER (extended) / count(*)::DOUBLE AS extended_ratio
  FROM obs GROUP BY 1),
t AS (SELECT a.*, coalesce(feet, 0) AS feet, CASE WHEN duration > 0 THEN coalesce(feet, 0) / duration ELSE 0 END AS rate FROM a LEFT JOIN d USING (track_id)),
r AS (SELECT *, list_filter([CASE WHEN duration < 86400 THEN 'short_duration' END, CASE WHEN observations < 3 THEN 'few_observations' END,
    CASE WHEN inside_ratio < 0.6 THEN 'mostly_outside_court' END, CASE WHEN extended_ratio < 0.7 THEN 'outside_extended_court' END,
    CASE WHEN duration >= 86400 AND rate < 0.00012 THEN 'limited_court_movement' END, CASE WHEN confidence < 0.45 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS reasons FROM t)"""

TRACK_SQL = f"""
WITH {OBS_SQL}, {_TRACKS}
SELECT track_id, player_id, first_frame, last_frame, observations, round(duration, 6) AS duration_seconds, round(confidence, 9) AS confidence, round(inside_ratio, 6) AS inside_ratio,
  round(extended_ratio, 6) AS extended_ratio, round(feet, 6) AS distance_feet, round(rate, 9) AS feet_per_second, array_to_string(reasons, ',') AS rejection_reasons, len(reasons) = 0 AS eligible FROM r
"""


def track_topk(spark, sf_dir):
    """The four best eligible tracks of each analysis: distance, rate, duration, confidence, then the smallest id."""
    tracks = track_summary(spark, sf_dir).where("eligible").withColumn("analysis_id", F.col("player_id") % 10)
    rank = F.row_number().over(Window.partitionBy("analysis_id").orderBy(*[F.desc(x) for x in ("distance_feet", "feet_per_second", "duration_seconds", "confidence")], F.col("track_id")))
    return tracks.withColumn("rank", rank.cast("long")).where("rank <= 4").select("analysis_id", "rank", "track_id", "distance_feet")


TOPK_SQL = f"""
WITH {OBS_SQL}, {_TRACKS}, e AS (SELECT player_id % 10 AS analysis_id, track_id, round(feet, 6) AS distance_feet, round(rate, 9) AS rate, round(duration, 6) AS duration, round(confidence, 9) AS confidence FROM r WHERE len(reasons) = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY distance_feet DESC, rate DESC, duration DESC, confidence DESC, track_id) AS rank FROM e)
SELECT analysis_id, rank, track_id, distance_feet FROM k WHERE rank <= 4
"""


def representative_rows(spark, sf_dir):
    """Per track the observation with the largest confidence times root of size, the first among equals."""
    return T.representatives(observations(spark, sf_dir))


REPRESENTATIVE_SQL = f"""
WITH {OBS_SQL}, s AS (SELECT track_id, frame_index, confidence, round(confidence * sqrt(1 + abs(value)), 9) AS score FROM obs WHERE extended)
SELECT track_id, frame_index, confidence, score FROM s QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, frame_index) = 1
"""


def fragment_summary(spark, sf_dir):
    df = T.fragments(observations(spark, sf_dir), COURT, POLICY)
    return df.select("track_id", "player_id", "analysis_id", "first_us", "last_us", "observations", *[F.round(c, 9).alias(c) for c in ("first_x", "first_y", "last_x", "last_y", "area", "median_y")], "side")


FRAGMENTS_CTE = """
fi AS (SELECT track_id, arg_min(court_x, (ts_us, frame_index)) AS fx, arg_min(court_y, (ts_us, frame_index)) AS fy, arg_max(court_x, (ts_us, frame_index)) AS lx, arg_max(court_y, (ts_us, frame_index)) AS ly,
    list_sort(list(court_y))[count(*) // 2 + 1] AS median_y FROM obs WHERE inside GROUP BY 1),
fa AS (SELECT track_id, min(player_id) AS player_id, min(analysis_id) AS analysis_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS observations, avg(1 + abs(value)) AS area,
    arg_min(court_x, (ts_us, frame_index)) AS ax, arg_min(court_y, (ts_us, frame_index)) AS ay, arg_max(court_x, (ts_us, frame_index)) AS bx, arg_max(court_y, (ts_us, frame_index)) AS by_ FROM obs GROUP BY 1),
fr AS (SELECT track_id, player_id, analysis_id, first_us, last_us, observations, coalesce(fx, ax) AS first_x, coalesce(fy, ay) AS first_y, coalesce(lx, bx) AS last_x, coalesce(ly, by_) AS last_y, area, median_y,
    CASE WHEN median_y IS NULL OR abs(median_y - 22) <= 2.5 THEN 'UNKNOWN' WHEN median_y < 22 THEN 'NEAR' ELSE 'FAR' END AS side FROM fa LEFT JOIN fi USING (track_id))"""

FRAGMENT_SQL = f"""
WITH {OBS_SQL}, {FRAGMENTS_CTE}
SELECT track_id, player_id, analysis_id, first_us, last_us, observations, round(first_x, 9) AS first_x, round(first_y, 9) AS first_y, round(last_x, 9) AS last_x, round(last_y, 9) AS last_y,
  round(area, 9) AS area, round(median_y, 9) AS median_y, side FROM fr
"""


def upper_median_interval(spark, sf_dir):
    pairs = W.with_next(observations(spark, sf_dir), ["track_id"], ["ts_us", "frame_index"], ["ts_us"])
    pairs = pairs.withColumn("gap", F.col("next_ts_us") - F.col("ts_us")).where("gap > 0")
    return pairs.groupBy("track_id").agg(W.upper_median(F.col("gap")).alias("upper_median_us"))


UPPER_SQL = f"""
WITH {OBS_SQL}, g AS (SELECT track_id, lead(ts_us) OVER (PARTITION BY track_id ORDER BY ts_us, frame_index) - ts_us AS gap FROM obs)
SELECT track_id, list_sort(list(gap))[count(*) // 2 + 1] AS upper_median_us FROM g WHERE gap > 0 GROUP BY 1
"""


def range_mean(spark, sf_dir):
    obs = W.sessions(observations(spark, sf_dir).where("inside"), ["track_id"], "ts_us", 21_600_000_000, ["frame_index"])
    out = W.range_mean(obs, ["track_id", "segment"], "ts_us", 14_400_000_000, ["court_x", "court_y"])
    return out.select("track_id", "segment", "frame_index", F.round("mean_court_x", 9).alias("mean_x"), F.round("mean_court_y", 9).alias("mean_y"))


SMOOTH_CTE = """
g1 AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY track_id ORDER BY ts_us, frame_index) > 21600000000 THEN 1 ELSE 0 END AS brk FROM obs WHERE inside),
g2 AS (SELECT *, (sum(brk) OVER (PARTITION BY track_id ORDER BY ts_us, frame_index ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM g1),
g3 AS (SELECT *, avg(court_x) OVER w AS mean_x, avg(court_y) OVER w AS mean_y FROM g2
  WINDOW w AS (PARTITION BY track_id, segment ORDER BY ts_us RANGE BETWEEN 14400000000 PRECEDING AND 14400000000 FOLLOWING))"""

RANGE_SQL = f"WITH {OBS_SQL}, {SMOOTH_CTE} SELECT track_id, segment, frame_index, round(mean_x, 9) AS mean_x, round(mean_y, 9) AS mean_y FROM g3"


def session_windows(spark, sf_dir):
    """Sessions of a player by gaps of more than six hours, through the built-in session window."""
    obs = observations(spark, sf_dir).withColumn("at", F.timestamp_micros("ts_us"))
    return obs.groupBy("player_id", F.session_window("at", "6 hours").alias("s")).agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("observations")
    ).drop("s")


SESSION_SQL = f"""
WITH {OBS_SQL}, g AS (SELECT player_id, ts_us, CASE WHEN ts_us - lag(ts_us) OVER w > 21600000000 THEN 1 ELSE 0 END AS brk FROM obs WINDOW w AS (PARTITION BY player_id ORDER BY ts_us)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY player_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT player_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS observations FROM s GROUP BY player_id, k
"""


def tumbling_windows(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("at", F.timestamp_micros("ts_us"))
    out = obs.groupBy("analysis_id", F.window("at", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("player_id").alias("players"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("confidence")
    )
    return out.select("analysis_id", F.expr("unix_micros(w.start) div 86400000000").alias("win"), "observations", "players", "confidence")


TUMBLING_SQL = f"""
WITH {OBS_SQL} SELECT analysis_id, ts_us // 86400000000 AS win, count(*) AS observations, count(DISTINCT player_id) AS players, sum(round(confidence * 100)::BIGINT)::BIGINT AS confidence FROM obs GROUP BY 1, 2
"""

QUERIES = {
    f.__name__: f
    for f in (
        movement_summary, obs_projection, zone_dwell, frame_dedup, path_length_variants, track_summary, track_topk, representative_rows,
        fragment_summary, upper_median_interval, range_mean, session_windows, tumbling_windows,
    )
}
ORACLES = {
    "movement_summary": MOVEMENT_SQL, "obs_projection": PROJECTION_SQL, "zone_dwell": ZONE_SQL, "frame_dedup": DEDUP_SQL, "path_length_variants": PATHS_SQL,
    "track_summary": TRACK_SQL, "track_topk": TOPK_SQL, "representative_rows": REPRESENTATIVE_SQL, "fragment_summary": FRAGMENT_SQL,
    "upper_median_interval": UPPER_SQL, "range_mean": RANGE_SQL, "session_windows": SESSION_SQL, "tumbling_windows": TUMBLING_SQL,
}
