"""Queries over logs of manual merges, each with the DuckDB statement that checks it.

Four players are a collection, so it has twelve tracks at most; every event is an entry of its collection's log, about the tracks in a run of places that follows from its id.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import association as J
from ..operators import merge_log as M
from ..session import written
from ..sources.observations import OBS_SQL, observations
from .activity_queries import _ROLLUP


def _candidates(spark, sf_dir):
    """The later two tracks of a player with an even id are one candidate, others are alone; every seventh first track makes a rejected one."""
    tracks = observations(spark, sf_dir).select("player_id", "track_id").distinct()
    slot = F.col("track_id") % 10
    group = F.when(F.col("player_id") % 2 == 0, F.col("player_id") * 10 + F.least(slot, F.lit(1))).otherwise(F.col("track_id"))
    rows = tracks.withColumns({"collection_id": F.expr("player_id div 4"), "group": group})
    rows = rows.groupBy("collection_id", "group").agg(F.array_sort(F.collect_list("track_id")).alias("tracks"))  # three at most
    first = F.col("tracks")[0]
    rejected = first % 7 == 0
    reason = F.when(rejected & (first % 3 > 0), F.concat(F.lit("reason_"), (first % 3).cast("string")))
    return rows.select("collection_id", first.alias("place"), "tracks", rejected.alias("rejected"), reason.alias("reason"))


def _log(spark, sf_dir):
    e = F.col("frame_index")
    obs = observations(spark, sf_dir).select(F.expr("player_id div 4").alias("collection_id"), e.alias("seq"), F.when(e % 4 >= 2, "UNDO").otherwise("MERGE").alias("action"), F.expr("frame_index div 4 * 7 % 12").alias("a"), F.expr("frame_index div 4 % 3 + 2").alias("n"))
    tracks = F.expr("transform(sequence(a, least(a + n, 12) - 1), p -> collection_id * 40 + p div 3 * 10 + p % 3)")
    return obs.select("collection_id", "seq", "action", tracks.alias("tracks"))


def _text(column):
    return F.array_join(F.transform(column, lambda t: t.cast("string")), ",")


def merge_replay(spark, sf_dir):
    """Candidates after the log, with the entry that made them."""
    rows = M.replay(_candidates(spark, sf_dir), _log(spark, sf_dir)).where("kind = 'candidate'")
    return rows.select("collection_id", F.col("seq").alias("made_by"), _text("tracks").alias("tracks"), "rejected", "reason")


def merge_log_states(spark, sf_dir):
    """What became of every entry of the log."""
    log = written(M.standing(_log(spark, sf_dir)), "standing")
    applied = M.replay(_candidates(spark, sf_dir), log).where("kind = 'merge'").select("collection_id", "seq", (F.col("place") == 1).alias("applied"))
    rows = log.join(applied, ["collection_id", "seq"], "left")
    state = F.when(F.col("state") == "ACTIVE", F.when(F.col("applied"), "APPLIED").otherwise("SKIPPED")).otherwise(F.col("state"))
    return rows.select("collection_id", "seq", "action", _text("tracks").alias("tracks"), state.alias("state"))


def merged_rollup(spark, sf_dir):
    """The roll-up of candidates after the log."""
    own = M.membership(M.replay(_candidates(spark, sf_dir), _log(spark, sf_dir)))
    return J.rollup(observations(spark, sf_dir), own)


def review_carry_over(spark, sf_dir):
    """A regrouping by the log: what passes of the reviews and the choice of the candidates before it.

    Collections divisible by five have a track from before candidates, and none of these; the others have chosen their candidate number collection % 6.
    """
    before = _candidates(spark, sf_dir)
    after = written(M.replay(before, _log(spark, sf_dir)).where("kind = 'candidate'"), "regrouped")
    name = lambda mark: F.concat(F.lit("c"), F.col("tracks")[0].cast("string"), F.lit("x"), F.size("tracks").cast("string"), mark).alias("candidate_id")
    renamed = F.when(F.col("tracks")[0] % 3 == 0, "b").otherwise("")  # ids that the regrouping changes
    order = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.col("seq").asc_nulls_first(), F.col("tracks")[0]))
    after = after.select("collection_id", name(renamed), order.alias("place"), "tracks")
    before = before.where("collection_id % 5 > 0").select("collection_id", name(F.lit("")), "place", "tracks", (F.col("place") % 2 == 1).alias("eligible"), "rejected", "reason")
    nth = F.row_number().over(Window.partitionBy("collection_id").orderBy("place")) - 1
    selected = before.withColumn("nth", nth).where("nth = collection_id % 6").select("collection_id", F.col("candidate_id").alias("selected_id"))
    legacy = after.select("collection_id").distinct().where("collection_id % 5 = 0").withColumn("track_id", F.col("collection_id") * 40 + F.col("collection_id") % 4 * 10 + 1)
    chosen = M.carried_selection(after, before, selected, legacy)
    kept = M.carried_rejections(after, before).join(chosen, ["collection_id", "candidate_id"], "left")
    return kept.select("collection_id", "candidate_id", "rejected", "reason", F.col("how").alias("selected_by"))


_LOG = f"""
WITH RECURSIVE {OBS_SQL},
tr AS (SELECT DISTINCT player_id, track_id, CASE WHEN player_id % 2 = 0 THEN player_id * 10 + least(track_id % 10, 1) ELSE track_id END AS grp FROM obs),
gr AS (SELECT player_id // 4 AS collection_id, list_sort(list(track_id)) AS tracks FROM tr GROUP BY 1, grp),
ca AS (SELECT collection_id, tracks[1] AS place, tracks, tracks[1] % 7 = 0 AS rejected, CASE WHEN tracks[1] % 7 = 0 AND tracks[1] % 3 > 0 THEN 'reason_' || tracks[1] % 3 END AS reason FROM gr),
lg AS (SELECT player_id // 4 AS collection_id, frame_index AS seq, CASE WHEN frame_index % 4 >= 2 THEN 'UNDO' ELSE 'MERGE' END AS action,
    list_transform(range(frame_index // 4 * 7 % 12, least(frame_index // 4 * 7 % 12 + frame_index // 4 % 3 + 2, 12)), lambda p: player_id // 4 * 40 + p // 3 * 10 + p % 3) AS tracks FROM obs),
st AS (SELECT *, CASE WHEN action = 'MERGE' THEN CASE WHEN max(seq) FILTER (action = 'UNDO') OVER (PARTITION BY collection_id, tracks) > seq THEN 'UNDONE' ELSE 'ACTIVE' END
    WHEN lag(action) OVER (PARTITION BY collection_id, tracks ORDER BY seq) = 'MERGE' THEN 'DONE' ELSE 'NOT_FOUND' END AS state FROM lg),
ac AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY seq) AS k FROM st WHERE state = 'ACTIVE'),
cur AS (
  SELECT collection_id, 0 AS k, list({{'s': NULL::BIGINT, 't': tracks, 'r': rejected, 'w': reason}} ORDER BY place) AS held, NULL::BIGINT AS seq, false AS applied FROM ca GROUP BY 1
  UNION ALL
  SELECT collection_id, k + 1, CASE WHEN ok THEN list_append(list_filter(held, lambda c: NOT list_has_all(tracks, c.t)),
      {{'s': seq, 't': tracks, 'r': bad, 'w': CASE WHEN bad THEN coalesce(list_filter(source, lambda c: c.w IS NOT NULL)[1].w, 'not_a_player') END}}) ELSE held END, seq, ok
  FROM (SELECT *, len(flatten(list_transform(source, lambda c: c.t))) = len(tracks) AS ok, len(list_filter(source, lambda c: c.r)) > 0 AS bad
    FROM (SELECT c.collection_id, c.k, c.held, a.seq, a.tracks, list_filter(c.held, lambda x: list_has_all(a.tracks, x.t)) AS source FROM cur c JOIN ac a ON a.collection_id = c.collection_id AND a.k = c.k + 1))),
fin AS (SELECT collection_id, unnest(arg_max(held, k)) AS c FROM cur GROUP BY 1)"""

REPLAY_SQL = f"{_LOG} SELECT collection_id, c.s AS made_by, array_to_string(c.t, ',') AS tracks, c.r AS rejected, c.w AS reason FROM fin"
STATES_SQL = f"""{_LOG}
SELECT st.collection_id, st.seq, action, array_to_string(tracks, ',') AS tracks, CASE WHEN state = 'ACTIVE' THEN CASE WHEN applied THEN 'APPLIED' ELSE 'SKIPPED' END ELSE state END AS state
FROM st LEFT JOIN cur ON cur.collection_id = st.collection_id AND cur.seq = st.seq
"""
MERGED_ROLLUP_SQL = f"""{_LOG},
mb AS (SELECT c.t[1] AS grp, unnest(c.t) AS track_id FROM fin), {_ROLLUP.replace('player_id AS group_id, track_id,', 'mb.grp AS group_id, obs.track_id,').replace('FROM obs GROUP', 'FROM obs JOIN mb USING (track_id) GROUP')}
SELECT group_id, fragments, observations, round(inside_ratio, 6) AS inside_ratio, round(us / 1000000.0::DOUBLE, 6) AS seconds, round(span, 6) AS span, quality FROM q
"""
CARRY_SQL = f"""{_LOG},
af AS (SELECT collection_id, 'c' || c.t[1] || 'x' || len(c.t) || CASE WHEN c.t[1] % 3 = 0 THEN 'b' ELSE '' END AS candidate_id, c.t AS tracks, row_number() OVER (PARTITION BY collection_id ORDER BY c.s NULLS FIRST, c.t[1]) AS place FROM fin),
be AS (SELECT *, 'c' || tracks[1] || 'x' || len(tracks) AS candidate_id, row_number() OVER (PARTITION BY collection_id ORDER BY place) - 1 AS nth FROM ca WHERE collection_id % 5 > 0),
se AS (SELECT collection_id, candidate_id AS selected_id, tracks AS chosen FROM be WHERE nth = collection_id % 6),
ch AS (
  SELECT collection_id, candidate_id, 'ID' AS how FROM se JOIN af USING (collection_id) WHERE candidate_id = selected_id
  UNION ALL SELECT collection_id, arg_min(candidate_id, place), 'TRACKS' FROM se JOIN af USING (collection_id) WHERE tracks = chosen AND (collection_id, selected_id) NOT IN (SELECT collection_id, candidate_id FROM af) GROUP BY 1
  UNION ALL SELECT collection_id, arg_min(candidate_id, place), 'LEGACY' FROM af WHERE collection_id % 5 = 0 AND list_contains(tracks, collection_id * 40 + collection_id % 4 * 10 + 1) GROUP BY 1)
SELECT af.collection_id, af.candidate_id, be.tracks IS NOT NULL AS rejected, be.reason, how AS selected_by
FROM af LEFT JOIN be ON be.collection_id = af.collection_id AND be.tracks = af.tracks AND be.rejected AND be.place % 2 = 1
LEFT JOIN ch ON ch.collection_id = af.collection_id AND ch.candidate_id = af.candidate_id
"""

QUERIES = {f.__name__: f for f in (merge_replay, merge_log_states, merged_rollup, review_carry_over)}
ORACLES = {"merge_replay": REPLAY_SQL, "merge_log_states": STATES_SQL, "merged_rollup": MERGED_ROLLUP_SQL, "review_carry_over": CARRY_SQL}
