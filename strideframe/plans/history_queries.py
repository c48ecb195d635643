"""Queries over a player's history, each with the DuckDB statement that checks it: five days of a player are an analysis, measured by the movement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import movement as M
from ..sources.observations import OBS_SQL, observations
from .movement_queries import COURT, POLICY

ZONES = ["kitchen", "transition", "baseline"]


def _records(spark, sf_dir):
    """Analyses with their measurements; every ninth has no analytics, every fourth no match intelligence."""
    obs = observations(spark, sf_dir).withColumn("analysis_id", F.col("player_id") * 10 + F.expr("ts_us div 432000000000"))
    k = F.col("analysis_id")
    analyses = obs.groupBy("player_id", "analysis_id").agg(F.max("ts_us").alias("updated_at"), F.count(F.lit(1)).alias("rows"))
    analyses = analyses.select("player_id", "analysis_id", "updated_at", F.when(k % 5 > 0, F.col("rows") * 60.0).alias("tracked_seconds"), F.element_at(F.array(*map(F.lit, [*H.GATE_OF_QUALITY, "OTHER"])), (k % 7 % 5 + 1).cast("int")).alias("quality"))
    zones = M.zone_dwell(obs, POLICY, COURT, "analysis_id").select("analysis_id", *[F.col(f"{z}_seconds").alias(z) for z in ZONES], F.col("tracked_seconds").alias("zone_seconds"))
    seen = M.durations(obs, POLICY, "analysis_id").select("analysis_id", "observed_seconds")
    analytics = seen.join(zones, "analysis_id", "left").where(k % 9 > 0).withColumn("made_at", k * 1_000_000_000)
    match_iq = analyses.where(k % 4 > 0).select("analysis_id", (k * 900_000_000).alias("made_at"), F.when(k % 3 == 0, "failed").otherwise("generated").alias("status"))
    rows = H.joined_record(analyses, analytics, match_iq)
    return rows.withColumn("gate", H.system_gate(F.when(F.col("match_iq_available"), F.lit("CAUTIOUS")), F.col("quality")))


def analysis_records(spark, sf_dir):
    """Each analysis with what analytics and match intelligence say of it."""
    rows = _records(spark, sf_dir)
    return rows.select("analysis_id", "player_id", "evaluated_at", F.round("reliable_seconds", 6).alias("reliable_seconds"), "measurement_available", "match_iq_available", "gate")


def _groups(spark, sf_dir):
    rows = _records(spark, sf_dir).where("measurement_available")
    split = H.even_split(rows, ["player_id"], "analysis_id", "updated_at")
    return H.comparison_groups(split, ["player_id"], "updated_at", ["reliable_seconds", "zone_seconds", *ZONES])


def comparison_groups(spark, sf_dir):
    """The earlier and the recent half of a player's measured analyses."""
    rows = _groups(spark, sf_dir)
    ids = F.array_join(F.transform("analysis_ids", lambda i: i.cast("string")), ",").alias("analysis_ids")
    return rows.select("player_id", "split", "period_start", "period_end", "analyses", ids, *[F.round(c, 6).alias(c) for c in ("reliable_seconds", "zone_seconds")])


def play_style(spark, sf_dir):
    """The zone whose share of a player's tracked time changed most between the halves."""
    out = H.share_changes(_groups(spark, sf_dir), ["player_id"], ZONES, 5.0)
    return out.select("player_id", *[F.round(f"{z}_{s}", 6).alias(f"{z}_{s}") for z in ZONES for s in ("earlier", "recent")], "style", F.round("style_change", 6).alias("style_change"), "style_status")


_RECORDS = f"""
{OBS_SQL}, an AS (SELECT *, player_id * 10 + ts_us // 432000000000 AS a FROM obs),
p AS (SELECT a, ts_us, track_id, lead(ts_us) OVER w AS nt, lead(track_id) OVER w AS nk FROM an WINDOW w AS (PARTITION BY a ORDER BY ts_us, frame_index, track_id)),
c AS (SELECT a, ts_us, track_id, lead(ts_us) OVER w AS nt, lead(track_id) OVER w AS nk, CASE WHEN abs(court_y - 22) <= 7 THEN 'kitchen' WHEN abs(court_y - 22) <= 15 THEN 'transition' ELSE 'baseline' END AS zone
  FROM an WHERE inside WINDOW w AS (PARTITION BY a ORDER BY ts_us, frame_index, track_id)),
o AS (SELECT a, coalesce(sum(nt - ts_us) FILTER (nk = track_id AND nt > ts_us AND nt - ts_us <= 21600000000), 0) / 1000000.0::DOUBLE AS observed_seconds FROM p GROUP BY 1),
z AS (SELECT a, {", ".join(f"coalesce(sum(nt - ts_us) FILTER (nk = track_id AND nt - ts_us BETWEEN 0 AND 21600000000 AND zone = '{z}'), 0) / 1000000.0::DOUBLE AS {z}" for z in ZONES)} FROM c GROUP BY 1),
ba AS (SELECT player_id, a, max(ts_us) AS updated_at, count(*) AS n FROM an GROUP BY 1, 2),
re AS (SELECT ba.a AS analysis_id, player_id, updated_at, a % 9 > 0 AS measurement_available, a % 4 > 0 AND a % 3 > 0 AS match_iq_available,
    greatest(updated_at, CASE WHEN a % 9 > 0 THEN a * 1000000000 ELSE 0 END, CASE WHEN a % 4 > 0 THEN a * 900000000 ELSE 0 END) AS evaluated_at, coalesce(CASE WHEN a % 9 > 0 THEN observed_seconds END, CASE WHEN a % 5 > 0 THEN n * 60.0::DOUBLE END) AS reliable_seconds,
    CASE WHEN a % 4 > 0 AND a % 3 > 0 THEN 'CAUTIOUS' ELSE ['NORMAL', 'CAUTIOUS', 'MEASUREMENT_ONLY', 'INSUFFICIENT_EVIDENCE', NULL][a % 7 % 5 + 1] END AS gate, kitchen, transition, baseline FROM ba JOIN o USING (a) LEFT JOIN z USING (a)),
hs AS (SELECT *, row_number() OVER w AS back, count(*) OVER (PARTITION BY player_id) AS held FROM re WHERE measurement_available WINDOW w AS (PARTITION BY player_id ORDER BY updated_at DESC, analysis_id DESC)),
ht AS (SELECT *, CASE WHEN least(held, 8) < 4 THEN NULL WHEN back <= least(held, 8) // 2 THEN 'recent' WHEN back > least(held, 8) - least(held, 8) // 2 THEN 'earlier' END AS split FROM hs WHERE back <= 8),
gr AS (SELECT player_id, split, min(updated_at) AS period_start, max(updated_at) AS period_end, count(*) AS analyses, array_to_string(list(analysis_id ORDER BY updated_at, analysis_id), ',') AS analysis_ids, sum(reliable_seconds) AS reliable_seconds,
    sum(kitchen + transition + baseline) AS zone_seconds, sum(kitchen) AS kitchen, sum(transition) AS transition, sum(baseline) AS baseline FROM ht WHERE split IS NOT NULL GROUP BY 1, 2)"""

RECORDS_SQL = f"WITH {_RECORDS} SELECT analysis_id, player_id, evaluated_at, round(reliable_seconds, 6) AS reliable_seconds, measurement_available, match_iq_available, gate FROM re"
GROUPS_SQL = f"WITH {_RECORDS} SELECT player_id, split, period_start, period_end, analyses, analysis_ids, round(reliable_seconds, 6) AS reliable_seconds, round(zone_seconds, 6) AS zone_seconds FROM gr"
STYLE_SQL = f"""
WITH {_RECORDS},
sh AS (SELECT player_id, {", ".join(f"max({z} / nullif(kitchen + transition + baseline, 0) * 100) FILTER (split = '{s}') AS {z}_{s}" for z in ZONES for s in ("earlier", "recent"))} FROM gr GROUP BY 1),
mo AS (SELECT player_id, zone, change, row_number() OVER (PARTITION BY player_id ORDER BY abs(change) DESC, i) AS k FROM (
  {" UNION ALL ".join(f"SELECT player_id, {i} AS i, '{z}' AS zone, {z}_recent - {z}_earlier AS change FROM sh" for i, z in enumerate(ZONES))}) WHERE change IS NOT NULL)
SELECT sh.player_id, {", ".join(f"round({z}_{s}, 6) AS {z}_{s}" for z in ZONES for s in ("earlier", "recent"))}, zone AS style, round(change, 6) AS style_change,
  CASE WHEN change IS NULL THEN NULL WHEN abs(change) < 5 THEN 'NO_CLEAR_CHANGE' ELSE 'PROVISIONAL_CHANGE' END AS style_status FROM sh LEFT JOIN mo ON mo.player_id = sh.player_id AND k = 1
"""

QUERIES = {f.__name__: f for f in (analysis_records, comparison_groups, play_style)}
ORACLES = {"analysis_records": RECORDS_SQL, "comparison_groups": GROUPS_SQL, "play_style": STYLE_SQL}
