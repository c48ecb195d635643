"""Queries over fragments, motion features and the ball, each with the DuckDB statement that checks it where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import activity as A
from ..operators import association as J
from ..operators import ball as B
from ..operators import decisions as D
from ..operators import tracks as T
from ..operators import windows as W
from ..session import written
from ..sources.observations import OBS_SQL, observations
from .decision_queries import classified_cte
from .movement_queries import COURT, FRAGMENTS_CTE, POLICY, SMOOTH_CTE
from .policy import EVENT_ACTIVITY, EVENT_ASSOCIATION, BallPolicy

RULE = EVENT_ACTIVITY


def _fragments(spark, sf_dir):
    return T.fragments(observations(spark, sf_dir), COURT, POLICY)


def _looking(spark, sf_dir):
    """Fragments, every sixth without a descriptor and one in five with one of another length."""
    t = F.col("track_id")
    look = F.array(*[F.array(*map(F.lit, v)) for v in LOOKS])
    return _fragments(spark, sf_dir).withColumn("appearance", F.when(t % 6 > 0, look[(t % 5).cast("int")]))


#: Descriptors of length 1 by track % 5.
LOOKS = [(1.0, 0.0), (0.96, 0.28), (0.28, 0.96), (1.0, 0.0), (1.0, 0.0, 0.0)]


def association_edges(spark, sf_dir):
    out = J.association_edges(_looking(spark, sf_dir), EVENT_ASSOCIATION, J.intervals(observations(spark, sf_dir)))
    numbers = [F.round("distance", 6).alias("distance"), F.round("area_ratio", 6).alias("area_ratio"), F.round("speed", 9).alias("speed"), F.round("similarity", 6).alias("similarity")]
    return out.select("analysis_id", "from_track", "to_track", "gap_us", *numbers, F.array_join("reasons", ",").alias("reasons"))


_EDGES = f"""
{OBS_SQL}, {FRAGMENTS_CTE},
ap AS (SELECT *, CASE WHEN track_id % 6 > 0 THEN [{", ".join(f"[{', '.join(f'{x}::DOUBLE' for x in v)}]" for v in LOOKS)}][track_id % 5 + 1] END AS look FROM fr),
iv AS (SELECT track_id, gap FROM (SELECT track_id, lead(ts_us) OVER (PARTITION BY track_id ORDER BY ts_us, frame_index) - ts_us AS gap FROM obs) WHERE gap > 0),
p0 AS (SELECT a.analysis_id, a.track_id AS from_track, b.track_id AS to_track, b.first_us - a.last_us AS gap_us, least(a.last_us - a.first_us, b.last_us - b.first_us) AS us,
    sqrt((b.first_x - a.last_x) * (b.first_x - a.last_x) + (b.first_y - a.last_y) * (b.first_y - a.last_y)) AS distance, greatest(a.area, b.area) / least(a.area, b.area) AS area_ratio,
    CASE WHEN len(a.look) = len(b.look) THEN greatest(0, least(1, a.look[1] * b.look[1] + a.look[2] * b.look[2] + coalesce(a.look[3] * b.look[3], 0))) END AS similarity
  FROM ap a JOIN ap b ON a.analysis_id = b.analysis_id AND b.first_us > a.last_us AND b.first_us - a.last_us <= 172800000000
  WHERE NOT (a.side = 'NEAR' AND b.side = 'FAR' OR a.side = 'FAR' AND b.side = 'NEAR')),
p1 AS (SELECT * FROM p0 WHERE distance <= 14 AND area_ratio <= 1.75 AND coalesce(similarity >= 0.7::DOUBLE, true) AND (gap_us <= 64800000000 OR coalesce(similarity >= 0.96::DOUBLE, false) AND us >= 432000000000)),
md AS (SELECT from_track, to_track, list_sort(list(gap))[count(*) // 2 + 1] AS med FROM p1 JOIN iv ON iv.track_id = from_track OR iv.track_id = to_track GROUP BY 1, 2),
ed AS (SELECT p1.*, distance / (greatest(gap_us, coalesce(med, 1000000 / 30::DOUBLE)) / 1000000.0::DOUBLE) AS speed FROM p1 LEFT JOIN md USING (from_track, to_track))"""

EDGES_SQL = f"""
WITH {_EDGES}
SELECT analysis_id, from_track, to_track, gap_us, round(distance, 6) AS distance, round(area_ratio, 6) AS area_ratio, round(speed, 9) AS speed, round(similarity, 6) AS similarity,
  '{",".join(J.EDGE_REASONS)}' || CASE WHEN similarity IS NOT NULL THEN ',appearance_histogram_consistent' ELSE '' END || CASE WHEN gap_us > 64800000000 THEN ',appearance_supported_reentry' ELSE '' END AS reasons
FROM ed WHERE speed <= 1.5e-4::DOUBLE
"""


def association_groups(spark, sf_dir):
    return J.grouped_fragments(_looking(spark, sf_dir), EVENT_ASSOCIATION, J.intervals(observations(spark, sf_dir)))


GROUPS_SQL = f"""
WITH RECURSIVE {_EDGES},
es AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY gap_us, distance, area_ratio, from_track, to_track) AS k FROM ed WHERE speed <= 1.5e-4::DOUBLE),
gs AS (
  SELECT analysis_id, 0::BIGINT AS k, list({{'r': track_id, 'm': [{{'t': track_id, 's': first_us, 'e': last_us, 'd': side}}]}} ORDER BY track_id) AS held FROM fr GROUP BY 1
  UNION ALL
  SELECT analysis_id, k, CASE WHEN a.r = b.r OR len(list_filter(a.m, lambda x: len(list_filter(b.m, lambda y: least(x.e, y.e) - greatest(x.s, y.s) > 0 OR x.d <> y.d AND x.d <> 'UNKNOWN' AND y.d <> 'UNKNOWN')) > 0)) > 0 THEN held
    ELSE list_append(list_filter(held, lambda g: g.r <> a.r AND g.r <> b.r), {{'r': least(a.r, b.r), 'm': list_concat(a.m, b.m)}}) END
  FROM (SELECT g.analysis_id, e.k, held, list_filter(held, lambda h: len(list_filter(h.m, lambda x: x.t = e.from_track)) > 0)[1] AS a, list_filter(held, lambda h: len(list_filter(h.m, lambda x: x.t = e.to_track)) > 0)[1] AS b
    FROM gs g JOIN es e ON e.analysis_id = g.analysis_id AND e.k = g.k + 1)),
gf AS (SELECT analysis_id, unnest(arg_max(held, k)) AS g FROM gs GROUP BY 1)
SELECT analysis_id, unnest(list_transform(g.m, lambda x: x.t)) AS track_id, g.r AS group_id FROM gf
"""


def candidate_rollup(spark, sf_dir):
    """Groups are the players here, so that SQL can check the roll-up."""
    obs = observations(spark, sf_dir)
    return J.rollup(obs, obs.select("track_id", F.col("player_id").alias("group_id")).distinct())


_ROLLUP = """
k AS (SELECT player_id AS group_id, track_id, max(ts_us) - min(ts_us) AS us, count(*) AS n, count(*) FILTER (inside) AS n_in, min(court_x) FILTER (inside) AS x1, max(court_x) FILTER (inside) AS x2,
    min(court_y) FILTER (inside) AS y1, max(court_y) FILTER (inside) AS y2 FROM obs GROUP BY 1, 2),
g AS (SELECT group_id, count(*) AS fragments, sum(n)::BIGINT AS observations, sum(n_in) / sum(n)::DOUBLE AS inside_ratio, sum(us)::BIGINT AS us, greatest(max(x2) - min(x1), max(y2) - min(y1)) AS span FROM k GROUP BY 1),
q AS (SELECT *, CASE WHEN us >= 5000000 AND observations >= 15 AND inside_ratio >= 0.65 AND span >= 4 AND fragments <= 3 THEN 'STRONG'
    WHEN us >= 1000000 AND observations >= 3 AND inside_ratio >= 0.30 THEN 'USABLE' ELSE 'WEAK' END AS quality FROM g)"""

ROLLUP_SQL = f"""
WITH {OBS_SQL}, {_ROLLUP} SELECT group_id, fragments, observations, round(inside_ratio, 6) AS inside_ratio, round(us / 1000000.0::DOUBLE, 6) AS seconds, round(span, 6) AS span, quality FROM q
"""


def candidate_selection(spark, sf_dir):
    """Four of each analysis: the pinned one (the largest group id divisible by 17), then the best."""
    rows = candidate_rollup(spark, sf_dir).withColumn("analysis_id", F.col("group_id") % 10)
    last = F.max(F.when(F.col("group_id") % 17 == 0, F.col("group_id"))).over(Window.partitionBy("analysis_id"))
    rows = rows.withColumn("pinned", F.col("group_id").eqNullSafe(last))
    return J.selection(rows, ["analysis_id"], 4).select("analysis_id", "rank", "group_id", "quality", "pinned")


SELECTION_SQL = f"""
WITH {OBS_SQL}, {_ROLLUP}, l AS (SELECT group_id % 10 AS analysis_id, max(group_id) AS pin FROM q WHERE group_id % 17 = 0 GROUP BY 1),
r AS (SELECT group_id % 10 AS analysis_id, group_id, quality, row_number() OVER (PARTITION BY group_id % 10
  ORDER BY CASE quality WHEN 'STRONG' THEN 0 WHEN 'USABLE' THEN 1 ELSE 2 END, round(us / 1000000.0::DOUBLE, 6) DESC, observations DESC, group_id) AS rank FROM q)
SELECT analysis_id, rank, group_id, quality, group_id IS NOT DISTINCT FROM pin AS pinned FROM r LEFT JOIN l USING (analysis_id)
WHERE group_id IS NOT DISTINCT FROM pin OR rank <= CASE WHEN pin IS NOT NULL AND (SELECT r2.rank FROM r AS r2 WHERE r2.group_id = pin) > 4 THEN 3 ELSE 4 END
"""


def velocity_direction(spark, sf_dir):
    v = A.velocities(observations(spark, sf_dir), RULE)
    return v.select("track_id", "frame_index", "start_us", "end_us", F.round("speed", 9).alias("speed"), F.round("speed_change", 12).alias("speed_change"), "turn")


_SPEED = "0.0003125::DOUBLE"
VELOCITY_CTE = f"""
v1 AS (SELECT analysis_id, player_id, track_id, frame_index, ts_us, mean_x, mean_y, lag(ts_us) OVER w AS p_us, lag(mean_x) OVER w AS px, lag(mean_y) OVER w AS py FROM g3
  WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, frame_index)),
v2 AS (SELECT *, (mean_x - px) / ((ts_us - p_us) / 1000000.0::DOUBLE) AS vx, (mean_y - py) / ((ts_us - p_us) / 1000000.0::DOUBLE) AS vy FROM v1 WHERE ts_us - p_us BETWEEN 600000000 AND 21600000000),
v3 AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM v2),
v4 AS (SELECT *, lag(ts_us) OVER w AS l_us, lag(speed) OVER w AS l_speed, lag(vx) OVER w AS lx, lag(vy) OVER w AS ly FROM v3 WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, frame_index)),
v5 AS (SELECT *, CASE WHEN sqrt(lx * lx + ly * ly) * sqrt(vx * vx + vy * vy) > 0
    THEN degrees(acos(greatest(-1, least(1, (lx * vx + ly * vy) / (sqrt(lx * lx + ly * ly) * sqrt(vx * vx + vy * vy)))))) END AS angle FROM v4),
vel AS (SELECT analysis_id, player_id, track_id, frame_index, p_us AS start_us, ts_us AS end_us, speed,
    CASE WHEN ts_us - l_us BETWEEN 600000000 AND 21600000000 THEN abs(speed - l_speed) / ((ts_us - l_us) / 1000000.0::DOUBLE) END AS speed_change,
    coalesce(speed >= {_SPEED} AND l_speed >= {_SPEED} AND angle >= 50, false) AS turn FROM v5)"""

VELOCITY_SQL = f"""
WITH {OBS_SQL}, {SMOOTH_CTE}, {VELOCITY_CTE}
SELECT track_id, frame_index, start_us, end_us, round(speed, 9) AS speed, round(speed_change, 12) AS speed_change, turn FROM vel
"""


def observed_islands(spark, sf_dir):
    return A.observed_islands(observations(spark, sf_dir), RULE)


ISLANDS_CTE = """
i1 AS (SELECT analysis_id, player_id, track_id, ts_us, lead(ts_us) OVER w AS n_us, lead(track_id) OVER w AS nk FROM obs WHERE inside
  WINDOW w AS (PARTITION BY analysis_id, player_id ORDER BY ts_us, frame_index, track_id)),
i2 AS (SELECT analysis_id, player_id, ts_us AS s, n_us AS e FROM i1 WHERE nk = track_id AND n_us > ts_us AND n_us - ts_us <= 21600000000),
i3 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY player_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM i2),
i4 AS (SELECT *, sum(brk) OVER (PARTITION BY player_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM i3),
isl AS (SELECT analysis_id, player_id, min(s) AS start_us, max(e) AS end_us FROM i4 GROUP BY analysis_id, player_id, k)"""

ISLANDS_SQL = f"WITH {OBS_SQL}, {ISLANDS_CTE} SELECT * FROM isl"


def concurrency_sweep(spark, sf_dir):
    """Seconds in which at least two players of an analysis are observed."""
    out = W.concurrency(observed_islands(spark, sf_dir), ["analysis_id"], "start_us", "end_us", 2)
    return out.select("analysis_id", F.round(G.seconds(F.col("length")), 6).alias("seconds"))


def _sweep(source: str, keys: str, start: str, end: str, name: str) -> str:
    return f"""
{name}_e AS (SELECT {keys}, tick, sum(step) AS step FROM (SELECT {keys}, {start} AS tick, 1 AS step FROM {source} UNION ALL SELECT {keys}, {end}, -1 FROM {source}) GROUP BY ALL),
{name}_o AS (SELECT *, sum(step) OVER (PARTITION BY {keys} ORDER BY tick ROWS UNBOUNDED PRECEDING) AS n, lead(tick) OVER (PARTITION BY {keys} ORDER BY tick) AS until FROM {name}_e),
{name} AS (SELECT {keys}, coalesce(sum(until - tick) FILTER (n >= 2), 0)::BIGINT AS length FROM {name}_o GROUP BY ALL)"""


SWEEP_SQL = f"WITH {OBS_SQL}, {ISLANDS_CTE}, {_sweep('isl', 'analysis_id', 'start_us', 'end_us', 'sw')} SELECT analysis_id, round(length / 1000000.0::DOUBLE, 6) AS seconds FROM sw"


def window_features(spark, sf_dir):
    df = A.window_features(observations(spark, sf_dir), RULE, COURT)
    rounded = {c: F.round(c, n) for c, n in (("coverage", 9), ("speed", 12), ("intensity", 9), ("speed_change", 14), ("turn_rate", 12), ("stationary_share", 9))}
    return df.withColumns(rounded)


FEATURES_CTE = f"""
cl AS (SELECT analysis_id, player_id, win, greatest(start_us, win * 86400000000) AS s, least(end_us, (win + 1) * 86400000000) AS e
  FROM (SELECT *, unnest(generate_series(start_us // 86400000000, (end_us - 1) // 86400000000)) AS win FROM isl)),
cov AS (SELECT analysis_id, player_id, win, sum(e - s)::BIGINT AS cover_us FROM cl GROUP BY ALL HAVING sum(e - s) >= 0.05 * 86400000000),
own AS (SELECT cl.* FROM cl SEMI JOIN cov USING (analysis_id, player_id, win)), {_sweep('own', 'analysis_id, win', 's', 'e', 'tg')},
vw AS (SELECT *, greatest(start_us, win * 86400000000) AS s, least(end_us, (win + 1) * 86400000000) AS e
  FROM (SELECT *, unnest(generate_series(start_us // 86400000000, (end_us - 1) // 86400000000)) AS win FROM vel)),
vr AS (SELECT vw.*, e - s AS ov, end_us >= win * 86400000000 AND end_us < (win + 1) * 86400000000 AS fin FROM vw SEMI JOIN cov USING (analysis_id, player_id, win)),
mv AS (SELECT * FROM vr WHERE speed >= 0.0005::DOUBLE), {_sweep('mv', 'analysis_id, win', 's', 'e', 'sm')},
pl AS (SELECT analysis_id, player_id, win, sum(ov)::BIGINT AS ov, sum(speed * ov) AS wt, coalesce(sum(ov) FILTER (speed >= 0.0005::DOUBLE), 0)::BIGINT AS moving, coalesce(sum(ov) FILTER (speed <= 0.0001875::DOUBLE), 0)::BIGINT AS still,
    count(*) FILTER (fin AND turn) AS turns, sum(speed_change) FILTER (fin) AS chs, count(speed_change) FILTER (fin) AS chn FROM vr GROUP BY ALL),
ki AS (SELECT analysis_id, player_id, ts_us // 86400000000 AS win, avg(CASE WHEN abs(court_y - 22) <= 7 THEN 1 ELSE 0 END) AS kitchen_share FROM obs WHERE inside GROUP BY ALL),
pa AS (SELECT analysis_id, player_id, win, cover_us, coalesce(ov, 0) AS ov, wt, coalesce(moving, 0) AS moving, coalesce(still, 0) AS still, coalesce(turns, 0) AS turns, chs, coalesce(chn, 0) AS chn, kitchen_share, parts
  FROM cov LEFT JOIN pl USING (analysis_id, player_id, win) LEFT JOIN ki USING (analysis_id, player_id, win)
    LEFT JOIN (SELECT analysis_id, player_id, ts_us // 86400000000 AS win, count(DISTINCT track_id) AS parts FROM obs GROUP BY ALL) USING (analysis_id, player_id, win)),
ag AS (SELECT analysis_id, win, count(*) AS reliable_players, sum(cover_us) AS cover_us, sum(wt) / nullif(sum(ov), 0) AS speed, count(*) FILTER (moving >= 0.5::DOUBLE / 3 * 86400000000) AS moving_players, avg(still) AS still,
    sum(turns) AS turns, sum(chs) / nullif(sum(chn), 0) AS speed_change, count(*) FILTER (still >= 0.55::DOUBLE * 86400000000 AND kitchen_share >= 0.5) AS kitchen_players, max(parts) AS fragments FROM pa GROUP BY ALL),
vi AS (SELECT analysis_id, ts_us // 86400000000 AS win, count(DISTINCT player_id) AS visible_players FROM obs GROUP BY ALL),
ft AS (SELECT analysis_id, win, visible_players, coalesce(reliable_players, 0) AS reliable_players, coalesce(tg.length, 0) / 86400000000.0::DOUBLE AS coverage, coalesce(speed, 0) AS speed,
    least(1, coalesce(speed, 0) / 0.0025::DOUBLE) AS intensity, coalesce(speed_change, 0) AS speed_change, coalesce(turns / nullif(cover_us / 1000000.0::DOUBLE, 0), 0) AS turn_rate, coalesce(moving_players, 0) AS moving_players,
    coalesce(sm.length, 0) AS simultaneous_us, coalesce(still, 0) / 86400000000.0::DOUBLE AS stationary_share, coalesce(kitchen_players, 0) AS kitchen_players, coalesce(fragments, 0) AS fragments
  FROM vi LEFT JOIN ag USING (analysis_id, win) LEFT JOIN tg USING (analysis_id, win) LEFT JOIN sm USING (analysis_id, win))"""

_UPTO = f"WITH {OBS_SQL}, {SMOOTH_CTE}, {VELOCITY_CTE}, {ISLANDS_CTE}, {FEATURES_CTE}"
FEATURES_SQL = f"""
{_UPTO} SELECT analysis_id, win, visible_players, reliable_players, round(coverage, 9) AS coverage, round(speed, 12) AS speed, round(intensity, 9) AS intensity, round(speed_change, 14) AS speed_change,
  round(turn_rate, 12) AS turn_rate, moving_players, simultaneous_us, round(stationary_share, 9) AS stationary_share, kitchen_players, fragments FROM ft
"""


def _states(spark, sf_dir):
    return A.window_states(A.window_features(observations(spark, sf_dir), RULE, COURT), RULE)


def window_states(spark, sf_dir):
    return _states(spark, sf_dir).select("analysis_id", "win", "state", "reason", "gap_severity")


STATES_CTE = f"""
st AS (SELECT *, CASE WHEN reliable_players < 2 OR coverage < 0.3 THEN 'UNKNOWN' WHEN act THEN 'ACTIVE' WHEN idl THEN 'IDLE' ELSE 'UNKNOWN' END AS state,
    CASE WHEN reliable_players < 2 THEN 'FEW_PLAYERS' WHEN coverage < 0.3 THEN 'LOW_COVERAGE' WHEN act THEN 'MOVING_TOGETHER' WHEN idl THEN 'STATIONARY' WHEN kitchen_players > 0 THEN 'CONFLICTING_EVIDENCE,KITCHEN_LOW_MOVEMENT_SAFEGUARD' ELSE 'CONFLICTING_EVIDENCE' END AS reason,
    CASE WHEN 1 - coverage >= 0.35 THEN 'SEVERE' WHEN 1 - coverage >= 0.15 THEN 'MINOR' ELSE 'NONE' END AS gap_severity
  FROM (SELECT *, moving_players >= 2 AND simultaneous_us >= 0.35::DOUBLE / 3 * 86400000000 AND intensity >= 0.25 AS act, moving_players = 0 AND kitchen_players = 0 AND intensity <= 0.12 AND stationary_share >= 0.55 AS idl FROM ft))"""
STATES_SQL = f"{_UPTO}, {STATES_CTE} SELECT analysis_id, win, state, reason, gap_severity FROM st"


def state_intervals(spark, sf_dir):
    return A.state_intervals(_states(spark, sf_dir), RULE).withColumn("intensity", F.round("intensity", 9))


INTERVALS_CTE = """
n1 AS (SELECT *, CASE WHEN lag(state) OVER w = state AND win - lag(win) OVER w = 1 THEN 0 ELSE 1 END AS brk FROM st WINDOW w AS (PARTITION BY analysis_id ORDER BY win)),
n2 AS (SELECT *, sum(brk) OVER (PARTITION BY analysis_id ORDER BY win ROWS UNBOUNDED PRECEDING) AS k FROM n1),
iv AS (SELECT analysis_id, min(state) AS state, min(win) AS first_win, max(win) AS last_win, count(*) AS windows, min(reliable_players) AS reliable_players, min(moving_players) AS moving_players,
    sum(simultaneous_us)::BIGINT AS simultaneous_us, round(avg(intensity), 9) AS intensity, arg_max(gap_severity, CASE gap_severity WHEN 'SEVERE' THEN 2 WHEN 'MINOR' THEN 1 ELSE 0 END) AS gap_severity,
    array_to_string(list_sort(list_distinct(flatten(list(string_split(reason, ','))))), ',') AS reasons, max(kitchen_players) AS kitchen_players FROM n2 GROUP BY analysis_id, k)"""
INTERVALS_SQL = f"{_UPTO}, {STATES_CTE}, {INTERVALS_CTE} SELECT * FROM iv"


#: Limits of the classifier that fit days as windows.
DAYS = D.WindowPolicy(window_seconds=86_400.0, min_context=172_800.0, coverage=0.2, strong_coverage=0.45, minor_gap=0.5, severe_gap=0.8, direction_rate=2e-6)


def _classified(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return D.classified_windows(A.classifier_inputs(A.window_features(obs, RULE, COURT), obs, RULE), DAYS)


def classified_activity(spark, sf_dir):
    """The features of every day through the full classifier."""
    out = _classified(spark, sf_dir)
    return out.select("analysis_id", "win", "gap_severity", "continuity", "visibility", "state", "confidence", F.array_join("reason_codes", ",").alias("reason_codes"))


def activity_intervals(spark, sf_dir):
    """Runs of days of one state."""
    out = A.classified_intervals(_classified(spark, sf_dir))
    places = {"observed_ratio": 9, "speed": 12, "speed_change": 14, "intensity": 9, "direction_rate": 12, "stationary_seconds": 3, "simultaneous_seconds": 3}
    return out.withColumns({**{c: F.round(c, n) for c, n in places.items()}, "reason_codes": F.array_join("reason_codes", ",")})


_CLASSIFIED = f"""{_UPTO},
le AS (SELECT analysis_id, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS source_seconds FROM obs GROUP BY 1),
f AS (SELECT analysis_id, win, visible_players AS visible, reliable_players AS reliable, fragments, coverage, 1 - coverage AS gap_ratio, 86400::DOUBLE AS window_seconds, source_seconds, NULL::VARCHAR AS quality, true AS current,
    moving_players AS moving, simultaneous_us >= 0.35::DOUBLE / 3 * 86400000000 AS simultaneous, intensity, kitchen_players AS kitchen, stationary_share * 86400 AS stationary_seconds, turn_rate AS direction_rate, speed, speed_change,
    simultaneous_us / 1000000.0::DOUBLE AS simultaneous_seconds FROM ft JOIN le USING (analysis_id)), {classified_cte(DAYS)}"""
CLASSIFIED_SQL = f"{_CLASSIFIED} SELECT analysis_id, win, gap_severity, continuity, visibility, state, confidence, array_to_string(codes, ',') AS reason_codes FROM z"
_WEAKEST = lambda column, *ranks: f"[{', '.join(repr(r) for r in ranks)}][min(list_position([{', '.join(repr(r) for r in ranks)}], {column}))] AS {column}"
_LEVELS = ("NOT_AVAILABLE", "LOW", "MODERATE", "HIGH")
ACTIVITY_SQL = f"""{_CLASSIFIED},
m1 AS (SELECT *, CASE WHEN lag(state) OVER w = state AND win - lag(win) OVER w = 1 THEN 0 ELSE 1 END AS brk FROM z WINDOW w AS (PARTITION BY analysis_id ORDER BY win)),
m2 AS (SELECT *, sum(brk) OVER (PARTITION BY analysis_id ORDER BY win ROWS UNBOUNDED PRECEDING) AS run FROM m1)
SELECT analysis_id, min(state) AS state, min(win) AS first_win, max(win) AS last_win, count(*) AS windows, round(avg(coverage), 9) AS observed_ratio, min(visible) AS visible, min(reliable) AS reliable, min(moving) AS moving, max(kitchen) AS kitchen,
  bool_and(simultaneous) AS simultaneous, round(sum(simultaneous_seconds), 3) AS simultaneous_seconds, round(sum(stationary_seconds), 3) AS stationary_seconds, round(avg(speed), 12) AS speed, round(avg(speed_change), 14) AS speed_change,
  round(avg(intensity), 9) AS intensity, round(avg(direction_rate), 12) AS direction_rate, {_WEAKEST("confidence", *_LEVELS)}, {_WEAKEST("visibility", *_LEVELS)}, {_WEAKEST("continuity", "NOT_AVAILABLE", "POOR", "LIMITED", "STRONG")},
  {_WEAKEST("gap_severity", "SEVERE", "MINOR", "NONE")}, array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') AS reason_codes FROM m2 GROUP BY analysis_id, run
"""


def state_totals(spark, sf_dir):
    """Windows by state and analysis, zeros kept, and their share."""
    states = F.explode(F.array(*[F.lit(x) for x in ("ACTIVE", "IDLE", "UNKNOWN")])).alias("state")
    rows = _states(spark, sf_dir).groupBy("analysis_id", "state").agg(F.count(F.lit(1)).alias("n"))
    dense = rows.select("analysis_id").distinct().select("analysis_id", states)
    out = dense.join(rows, ["analysis_id", "state"], "left").select("analysis_id", "state", F.coalesce("n", F.lit(0)).alias("windows"))
    return out.withColumn("percent", F.round(F.col("windows") * 100 / F.sum("windows").over(Window.partitionBy("analysis_id")), 6))


TOTALS_SQL = f"""
{_UPTO}, {STATES_CTE}, d AS (SELECT DISTINCT analysis_id, s.state FROM st, (VALUES ('ACTIVE'), ('IDLE'), ('UNKNOWN')) s(state)),
c AS (SELECT d.analysis_id, d.state, count(st.win) AS windows FROM d LEFT JOIN st ON d.analysis_id = st.analysis_id AND d.state = st.state GROUP BY ALL)
SELECT analysis_id, state, windows, round(windows * 100::DOUBLE / sum(windows) OVER (PARTITION BY analysis_id), 6) AS percent FROM c
"""


def reason_histogram(spark, sf_dir):
    rows = _states(spark, sf_dir).select("analysis_id", F.explode(F.split("reason", ",")).alias("reason"))
    return rows.groupBy("analysis_id", "reason").agg(F.count(F.lit(1)).alias("windows"))


REASONS_SQL = f"{_UPTO}, {STATES_CTE} SELECT analysis_id, reason, count(*) AS windows FROM (SELECT analysis_id, unnest(string_split(reason, ',')) AS reason FROM st) GROUP BY ALL"


def review_overlap_state(spark, sf_dir):
    """Review intervals of two and a half windows, one at every third window up to an analysis's last, against window states: the state of the largest overlap, UNKNOWN on a tie or where any is unknown."""
    width = RULE.window_us
    states = window_states(spark, sf_dir).select("analysis_id", "win", "state")
    last = states.groupBy("analysis_id").agg(F.max("win").alias("last"))
    review = last.select("analysis_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 3).cast("int"))).alias("k"))
    review = review.withColumns({"start_us": (F.col("k") * 3 * width).cast("long"), "end_us": (F.col("k") * 3 * width + 5 * width / 2).cast("long")})
    cut = W.clipped(review, "start_us", "end_us", width).join(states, ["analysis_id", "win"], "left")
    overlap = cut.groupBy("analysis_id", "k", "state").agg(F.sum(F.col("clip_end") - F.col("clip_start")).alias("us"))
    best = overlap.groupBy("analysis_id", "k").agg(
        F.max(F.when(F.col("state") != "UNKNOWN", F.col("us"))).alias("top"),
        F.bool_or(F.col("state").eqNullSafe("UNKNOWN")).alias("unknown"),
        F.max_by("state", F.struct(F.coalesce("state", F.lit("UNKNOWN")) != "UNKNOWN", "us")).alias("state"),
        F.array_sort(F.collect_list(F.when(F.col("state") != "UNKNOWN", F.col("us")))).alias("all"),
    )
    tie = (F.size("all") > 1) & (F.try_element_at("all", F.lit(-1)) == F.try_element_at("all", F.lit(-2)))
    return best.select("analysis_id", "k", F.when(F.col("unknown") | tie | F.col("top").isNull(), "UNKNOWN").otherwise(F.col("state")).alias("state"))


REVIEW_SQL = f"""
{_UPTO}, {STATES_CTE},
r AS (SELECT DISTINCT analysis_id, k::INTEGER AS k, (k * 3 * 86400000000)::BIGINT AS s, (k * 3 * 86400000000 + 216000000000)::BIGINT AS e FROM (SELECT analysis_id, unnest(generate_series(0, max(win) // 3)) AS k FROM st GROUP BY analysis_id)),
o AS (SELECT r.analysis_id, r.k, st.state, sum(least(r.e, (st.win + 1) * 86400000000) - greatest(r.s, st.win * 86400000000)) AS us FROM r LEFT JOIN st ON r.analysis_id = st.analysis_id
    AND st.win * 86400000000 < r.e AND (st.win + 1) * 86400000000 > r.s GROUP BY ALL),
b AS (SELECT analysis_id, k, bool_or(coalesce(state = 'UNKNOWN', false)) AS unknown, max(us) FILTER (state <> 'UNKNOWN') AS top FROM o GROUP BY ALL)
SELECT b.analysis_id, b.k, CASE WHEN unknown OR top IS NULL OR (SELECT count(*) FROM o WHERE o.analysis_id = b.analysis_id AND o.k = b.k AND o.us = b.top AND state <> 'UNKNOWN') > 1 THEN 'UNKNOWN'
  ELSE (SELECT min(state) FROM o WHERE o.analysis_id = b.analysis_id AND o.k = b.k AND o.us = b.top AND state <> 'UNKNOWN') END AS state FROM b
"""


def boundary_error(spark, sf_dir):
    """Absolute errors of interval starts and ends against the same intervals one window later: mean, largest and share within a window."""
    rows = state_intervals(spark, sf_dir).where("state <> 'UNKNOWN'")
    w = Window.partitionBy("analysis_id").orderBy("first_win")
    rows = rows.withColumns({"other_first": F.lead("first_win").over(w), "other_last": F.lead("last_win").over(w)}).where("other_first IS NOT NULL")
    errors = rows.select("analysis_id", F.explode(F.array(F.abs(F.col("other_first") - F.col("first_win")), F.abs(F.col("other_last") - F.col("last_win")))).alias("error"))
    return errors.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("boundaries"), F.round(F.avg("error"), 9).alias("mean_error"), F.max("error").alias("max_error"), F.count_if(F.col("error") <= 1).alias("within"))


BOUNDARY_SQL = f"""
{_UPTO}, {STATES_CTE}, {INTERVALS_CTE},
x AS (SELECT analysis_id, abs(lead(first_win) OVER w - first_win) AS a, abs(lead(last_win) OVER w - last_win) AS b FROM iv WHERE state <> 'UNKNOWN' WINDOW w AS (PARTITION BY analysis_id ORDER BY first_win)),
y AS (SELECT analysis_id, unnest([a, b]) AS error FROM x WHERE a IS NOT NULL)
SELECT analysis_id, count(*) AS boundaries, round(avg(error), 9) AS mean_error, max(error) AS max_error, count(*) FILTER (error <= 1) AS within FROM y GROUP BY 1
"""


def threshold_what_if(spark, sf_dir):
    """Window states under changed coverage thresholds: how many change, and how many of them become known."""
    features = A.window_features(observations(spark, sf_dir), RULE, COURT)
    rows = A.window_states(features, RULE).withColumnRenamed("state", "base")
    thresholds = (0.1, 0.2, 0.5)
    for k, threshold in enumerate(thresholds):
        rows = A.window_states(rows, RULE, threshold).withColumnRenamed("state", f"state_{k}")
    cases = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"state_{k}").alias("state")) for k, t in enumerate(thresholds)])
    rows = rows.select("base", F.explode(cases).alias("x")).select("base", "x.*")
    return rows.groupBy("threshold").agg(
        F.count_if(F.col("state") != F.col("base")).alias("affected"), F.count_if((F.col("base") == "UNKNOWN") & (F.col("state") != "UNKNOWN")).alias("known"), F.count(F.lit(1)).alias("windows")
    )


_IF = "CASE WHEN reliable_players < 2 OR coverage < {} THEN 'UNKNOWN' WHEN act THEN 'ACTIVE' WHEN idl THEN 'IDLE' ELSE 'UNKNOWN' END"
WHAT_IF_SQL = f"{_UPTO}, {STATES_CTE}" + " UNION ALL ".join(
    f" SELECT {t}::DOUBLE AS threshold, count(*) FILTER (({_IF.format(t)}) <> state) AS affected, count(*) FILTER (state = 'UNKNOWN' AND ({_IF.format(t)}) <> 'UNKNOWN') AS known, count(*) AS windows FROM st"
    for t in (0.1, 0.2, 0.5)
)


def _ball(spark, sf_dir):
    """A player's rows as frames of a ball: x and y in pixels, a candidate where the confidence is at least 0.4, but in the second of every three times five days."""
    obs = observations(spark, sf_dir)
    frame = F.row_number().over(Window.partitionBy("player_id").orderBy("ts_us", "frame_index")) - 1
    seen = (F.col("confidence") >= 0.4) & (F.expr("ts_us div 432000000000") % 3 != 1)
    return obs.select(F.col("player_id").alias("analysis_id"), frame.cast("long").alias("frame"), F.when(seen, F.col("court_x") * 3).alias("x"), F.when(seen, F.col("court_y") * 3).alias("y"), "confidence")


def ball_tracker(spark, sf_dir):
    out = B.reconstruct(_ball(spark, sf_dir), BallPolicy())
    return out.select("analysis_id", "frame", "segment", "interpolated", "gap", *[F.round(c, 6).alias(c) for c in ("x", "y", "confidence", "distance")])


def ball_events(spark, sf_dir):
    return B.events(_ball(spark, sf_dir), BallPolicy())


def ball_segments(spark, sf_dir):
    out = B.segments(B.reconstruct(_ball(spark, sf_dir), BallPolicy()), BallPolicy())
    return out.withColumn("mean_confidence", F.round("mean_confidence", 12))


def ball_path_report(spark, sf_dir):
    return B.report(_ball(spark, sf_dir), BallPolicy())


def ball_report(spark, sf_dir):
    return B.detections(_ball(spark, sf_dir))


#: The tracker frame by frame: bt has the state after every frame and, as o_*, the one before it.
_BALL = f"""
{OBS_SQL}, bf AS (SELECT player_id AS analysis_id, row_number() OVER (PARTITION BY player_id ORDER BY ts_us, frame_index) - 1 AS frame, confidence >= 0.4 AND ts_us // 432000000000 % 3 <> 1 AS seen,
    confidence AS c, court_x * 3 AS x, court_y * 3 AS y FROM obs),
bt AS (
  SELECT DISTINCT analysis_id, -1::BIGINT AS frame, NULL::BIGINT AS lf, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, NULL::DOUBLE AS lc, NULL::DOUBLE AS px, NULL::DOUBLE AS py, 0::BIGINT AS gap, 0::BIGINT AS segment,
    'none' AS did, NULL::BIGINT AS o_f, NULL::DOUBLE AS o_x, NULL::DOUBLE AS o_y, NULL::DOUBLE AS o_c, 0::BIGINT AS o_gap, 0::BIGINT AS o_segment, NULL::DOUBLE AS way FROM bf
  UNION ALL
  SELECT analysis_id, frame, CASE WHEN did IN ('start', 'go') THEN frame ELSE lf END, CASE WHEN did IN ('start', 'go') THEN x ELSE lx END, CASE WHEN did IN ('start', 'go') THEN y ELSE ly END,
    CASE WHEN did IN ('start', 'go') THEN c ELSE lc END, CASE did WHEN 'start' THEN NULL WHEN 'go' THEN lx ELSE px END, CASE did WHEN 'start' THEN NULL WHEN 'go' THEN ly ELSE py END,
    CASE WHEN did IN ('start', 'go') THEN 0 WHEN did = 'none' THEN 0 ELSE gap + 1 END, CASE WHEN did = 'start' THEN segment + 1 ELSE segment END, did, lf, lx, ly, lc, gap, segment, CASE WHEN did = 'go' THEN way END
  FROM (SELECT *, CASE WHEN NOT seen THEN CASE WHEN lf IS NULL THEN 'none' ELSE 'miss' END WHEN lf IS NULL OR gap > 8 THEN 'start'
      WHEN way > greatest(42 + gap * 24, coalesce(sqrt((lx - px) * (lx - px) + (ly - py) * (ly - py)) * (gap + 1) * 2.5::DOUBLE, 0)) THEN 'jump' ELSE 'go' END AS did
    FROM (SELECT f.*, b.lf, b.lx, b.ly, b.lc, b.px, b.py, b.gap, b.segment, sqrt((f.x - b.lx) * (f.x - b.lx) + (f.y - b.ly) * (f.y - b.ly)) AS way FROM bt b JOIN bf f ON f.analysis_id = b.analysis_id AND f.frame = b.frame + 1))),
po AS (
  SELECT analysis_id, frame, segment, false AS interpolated, 0::BIGINT AS gap, lx AS x, ly AS y, lc AS confidence, way AS distance FROM bt WHERE did IN ('start', 'go')
  UNION ALL
  SELECT analysis_id, o_f + k, segment, true, o_gap, o_x + k / (o_gap + 1)::DOUBLE * (lx - o_x), o_y + k / (o_gap + 1)::DOUBLE * (ly - o_y), least(o_c, lc) * 0.6::DOUBLE, NULL
  FROM (SELECT *, unnest(generate_series(1, o_gap)) AS k FROM bt WHERE did = 'go' AND o_gap BETWEEN 1 AND 4)),
ev AS (
  SELECT analysis_id, frame, 'segment_started' AS event, segment, NULL::BIGINT AS gap, NULL AS detail FROM bt WHERE did = 'start'
  UNION ALL SELECT analysis_id, o_f, 'segment_ended', o_segment, o_gap, 'association_gap_exceeded' FROM bt WHERE did = 'start' AND o_f IS NOT NULL
  UNION ALL SELECT analysis_id, frame, 'gap_started', segment, NULL, NULL FROM bt WHERE did = 'miss' AND gap = 1
  UNION ALL SELECT analysis_id, frame, 'reacquired', segment, o_gap, CASE WHEN o_gap <= 4 THEN 'short_gap_interpolated' ELSE 'long_gap_not_interpolated' END FROM bt WHERE did = 'go' AND o_gap > 0
  UNION ALL SELECT analysis_id, lf, 'segment_ended', segment, gap, 'stream_ended' FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY frame DESC) AS z FROM bt) WHERE z = 1 AND lf IS NOT NULL)"""

BALL_TRACKER_SQL = f"WITH RECURSIVE {_BALL} SELECT analysis_id, frame, segment, interpolated, gap, round(x, 6) AS x, round(y, 6) AS y, round(confidence, 6) AS confidence, round(distance, 6) AS distance FROM po"
BALL_EVENTS_SQL = f"WITH RECURSIVE {_BALL} SELECT * FROM ev"
BALL_SEGMENTS_SQL = f"""
WITH RECURSIVE {_BALL} SELECT analysis_id, segment, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS points, count(*) FILTER (NOT interpolated) AS observed, round(avg(confidence), 12) AS mean_confidence,
  count(*) FILTER (NOT interpolated) < 3 AS fragment FROM po GROUP BY 1, 2
"""
BALL_PATH_REPORT_SQL = f"""
WITH RECURSIVE {_BALL},
fr AS (SELECT analysis_id, count(*) AS frames, count(*) FILTER (seen) AS detected FROM bf GROUP BY 1),
pp AS (SELECT analysis_id, count(*) FILTER (NOT interpolated) AS observed, count(*) FILTER (interpolated) AS interpolated, quantile_cont(confidence, 0.1) FILTER (NOT interpolated) AS p10,
    quantile_cont(confidence, 0.5) FILTER (NOT interpolated) AS p50, quantile_cont(confidence, 0.9) FILTER (NOT interpolated) AS p90 FROM po GROUP BY 1),
ee AS (SELECT analysis_id, count(*) FILTER (event = 'segment_started') AS segments, count(*) FILTER (event = 'reacquired') AS reacquired, max(gap) FILTER (gap > 0) AS longest_gap, avg(gap) FILTER (gap > 0) AS mean_gap FROM ev GROUP BY 1),
jj AS (SELECT analysis_id, count(*) FILTER (did = 'jump') AS impossible FROM bt GROUP BY 1),
al AS (SELECT fr.*, coalesce(observed, 0) AS observed, coalesce(interpolated, 0) AS interpolated, coalesce(segments, 0) AS segments, coalesce(reacquired, 0) AS reacquired, coalesce(impossible, 0) AS impossible,
    coalesce(longest_gap, 0) AS longest_gap, round(coalesce(mean_gap, 0), 6) AS mean_gap, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90
  FROM fr LEFT JOIN pp USING (analysis_id) LEFT JOIN ee USING (analysis_id) LEFT JOIN jj USING (analysis_id))
SELECT *, round(detected / frames::DOUBLE, 6) AS coverage, round((observed + interpolated) / frames::DOUBLE, 6) AS path_coverage, round(greatest(segments - 1, 0) / greatest(observed, 1)::DOUBLE, 6) AS fragmentation,
  CASE WHEN observed = 0 THEN 'no_ball_detected' WHEN observed < 3 THEN 'insufficient_observations' WHEN segments >= 3 AND segments = observed THEN 'excessive_track_fragmentation' ELSE 'available' END AS status FROM al
"""
BALL_REPORT_SQL = f"""
WITH {OBS_SQL}, f AS (SELECT player_id AS analysis_id, row_number() OVER (PARTITION BY player_id ORDER BY ts_us, frame_index) - 1 AS frame, confidence >= 0.4 AND ts_us // 432000000000 % 3 <> 1 AS seen, confidence FROM obs),
g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY analysis_id ORDER BY frame) - 1 AS gap FROM f WHERE seen),
a AS (SELECT analysis_id, count(*) AS frames, count(*) FILTER (seen) AS detected FROM f GROUP BY 1),
b AS (SELECT analysis_id, quantile_cont(confidence, 0.1) AS p10, quantile_cont(confidence, 0.5) AS p50, quantile_cont(confidence, 0.9) AS p90, max(gap) AS longest_gap, avg(gap) FILTER (gap > 0) AS mean_gap FROM g GROUP BY 1)
SELECT analysis_id, frames, coalesce(detected, 0) AS detected, round(detected / frames::DOUBLE, 6) AS coverage, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, longest_gap, round(mean_gap, 9) AS mean_gap
FROM a LEFT JOIN b USING (analysis_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        association_edges, association_groups, candidate_rollup, candidate_selection, velocity_direction, observed_islands, concurrency_sweep, window_features,
        window_states, state_intervals, classified_activity, activity_intervals, state_totals, reason_histogram, review_overlap_state, boundary_error, threshold_what_if, ball_tracker, ball_events, ball_segments, ball_path_report, ball_report,
    )
}
ORACLES = {
    "association_edges": EDGES_SQL, "association_groups": GROUPS_SQL, "candidate_rollup": ROLLUP_SQL, "candidate_selection": SELECTION_SQL, "velocity_direction": VELOCITY_SQL, "observed_islands": ISLANDS_SQL,
    "concurrency_sweep": SWEEP_SQL, "window_features": FEATURES_SQL, "window_states": STATES_SQL, "state_intervals": INTERVALS_SQL, "classified_activity": CLASSIFIED_SQL, "activity_intervals": ACTIVITY_SQL, "state_totals": TOTALS_SQL,
    "reason_histogram": REASONS_SQL, "review_overlap_state": REVIEW_SQL, "boundary_error": BOUNDARY_SQL, "threshold_what_if": WHAT_IF_SQL, "ball_report": BALL_REPORT_SQL,
    "ball_tracker": BALL_TRACKER_SQL, "ball_events": BALL_EVENTS_SQL, "ball_segments": BALL_SEGMENTS_SQL, "ball_path_report": BALL_PATH_REPORT_SQL,
}
