"""Queries over the decision ladders and scalar functions, each with the DuckDB statement that checks it.

The tables hold no reports or recordings; adapter views derive their fields from integers of `orders`, `events` and `documents`, so that each rule meets both outcomes.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decisions as D
from ..session import table

# ---- window classifier ----

WINDOW_FIELDS = {
    "visible": "k % 5", "reliable": "least(k % 5, (k DIV 5) % 4)", "fragments": "1 + (k DIV 7) % 2", "coverage": "(CASE WHEN k % 3 = 0 THEN 90 ELSE k * 37 % 101 END) / 100.0D",
    "gap_ratio": "(CASE WHEN k % 4 < 2 THEN k % 12 ELSE k * 13 % 60 END) / 100.0D", "window_seconds": "CASE WHEN k % 23 = 0 THEN 2.5D ELSE 3.0D END", "source_seconds": "CASE WHEN k % 29 = 0 THEN 4.0D ELSE 60.0D END",
    "quality": "CASE k % 11 WHEN 0 THEN 'UNSUITABLE' WHEN 1 THEN NULL ELSE 'GOOD' END", "current": "k % 31 <> 0", "moving": "CASE WHEN k % 2 = 0 THEN 0 ELSE least(k % 5, (k DIV 5) % 4) - (k DIV 3) % 2 END",
    "simultaneous": "k % 7 <> 0", "intensity": "(CASE WHEN k % 2 = 0 THEN k % 15 ELSE k * 17 % 101 END) / 100.0D", "kitchen": "CASE WHEN k % 13 < 4 THEN 1 ELSE 0 END", "stationary_seconds": "(k * 19 % 31) / 10.0D",
    "direction_rate": "(k % 17) / 100.0D",
}


def _fields(fields: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in fields.items())


def _sql(fields: dict[str, str]) -> str:
    """The same fields for DuckDB: its integer division and its doubles."""
    return re.sub(r"(\d+\.\d+)D", r"\1::DOUBLE", _fields(fields).replace(" DIV ", " // "))


def window_classifier(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS k").selectExpr("k", *[f"{t} AS {n}" for n, t in WINDOW_FIELDS.items()])
    out = D.classified_windows(rows)
    return out.select("k", "gap_severity", "continuity", "visibility", "state", "confidence", F.array_join("reason_codes", ",").alias("reason_codes"))


def classified_cte(p: D.WindowPolicy) -> str:
    """From inputs `f` to `z` with the state, its grades and the sorted list of codes."""
    return f"""
g AS (SELECT *, CASE WHEN gap_ratio >= {p.severe_gap} THEN 'SEVERE' WHEN gap_ratio >= {p.minor_gap} THEN 'MINOR' ELSE 'NONE' END AS gap_severity FROM f),
h AS (SELECT *, CASE WHEN reliable = 0 THEN 'NOT_AVAILABLE' WHEN gap_severity = 'SEVERE' THEN 'POOR' WHEN gap_severity = 'NONE' AND fragments = 1 THEN 'STRONG' ELSE 'LIMITED' END AS continuity,
    CASE WHEN reliable < {p.min_reliable} THEN 'NOT_AVAILABLE' WHEN coverage >= {p.strong_coverage} THEN 'HIGH' WHEN coverage >= {p.coverage} THEN 'MODERATE' ELSE 'LOW' END AS visibility,
    source_seconds < {p.min_context} OR window_seconds < {p.window_seconds} - 1e-6 AS short, coalesce(quality = 'UNSUITABLE', false) AS bad FROM g),
i AS (SELECT *, NOT (reliable < {p.min_reliable} OR coverage < {p.coverage} OR gap_severity = 'SEVERE' OR short OR bad OR NOT current) AS open FROM h),
j AS (SELECT *, CASE WHEN NOT open THEN 'UNKNOWN' WHEN moving >= {p.min_reliable} AND simultaneous AND intensity >= {p.active_intensity} THEN 'LIKELY_ACTIVE'
    WHEN moving = 0 AND kitchen = 0 AND intensity <= {p.idle_intensity} AND stationary_seconds >= window_seconds * {p.player_coverage}::DOUBLE THEN 'LIKELY_IDLE' ELSE 'UNKNOWN' END AS state FROM i),
z AS (SELECT *,
  CASE WHEN NOT open THEN 'NOT_AVAILABLE' WHEN state <> 'UNKNOWN' AND coverage >= {p.strong_coverage} AND continuity = 'STRONG' AND visibility = 'HIGH' THEN 'MODERATE' ELSE 'LOW' END AS confidence,
  list_sort(list_filter([CASE WHEN visible = 0 THEN 'NO_OBSERVATIONS' END, CASE WHEN reliable < {p.min_reliable} THEN 'INSUFFICIENT_RELIABLE_PLAYERS' END, CASE WHEN reliable = 1 THEN 'ONE_PLAYER_ONLY' END,
    CASE WHEN coverage >= {p.coverage} THEN 'SUFFICIENT_TRACKED_COVERAGE' ELSE 'INSUFFICIENT_TRACKED_COVERAGE' END, CASE WHEN gap_severity <> 'NONE' THEN 'TRACKING_GAP' END,
    CASE WHEN gap_severity = 'SEVERE' THEN 'SEVERE_TRACKING_GAPS' END, CASE WHEN continuity IN ('LIMITED', 'POOR') THEN 'FRAGMENTED_CANDIDATES' END, CASE WHEN bad THEN 'UNSUITABLE_RECORDING' END,
    CASE WHEN short THEN 'SHORT_CONTEXT' END, CASE WHEN NOT current THEN 'STALE_SOURCE_ARTIFACT' END, CASE WHEN state = 'LIKELY_ACTIVE' THEN 'SUSTAINED_MULTI_PLAYER_MOVEMENT' END,
    CASE WHEN state = 'LIKELY_ACTIVE' THEN 'SIMULTANEOUS_MOVEMENT' END, CASE WHEN state = 'LIKELY_ACTIVE' AND direction_rate >= {p.direction_rate} THEN 'MEANINGFUL_DIRECTION_CHANGES' END,
    CASE WHEN state = 'LIKELY_ACTIVE' AND moving < reliable THEN 'STATIONARY_PLAYER_WITH_ACTIVE_PEERS' END, CASE WHEN state = 'LIKELY_IDLE' THEN 'SUSTAINED_LOW_MOVEMENT' END,
    CASE WHEN state = 'LIKELY_IDLE' THEN 'STABLE_LOW_ACTIVITY' END, CASE WHEN open AND state = 'UNKNOWN' AND kitchen > 0 THEN 'KITCHEN_LOW_MOVEMENT_SAFEGUARD' END,
    CASE WHEN open AND state = 'UNKNOWN' THEN 'CONFLICTING_EVIDENCE' END], lambda x: x IS NOT NULL)) AS codes FROM j)"""


WINDOW_SQL = f"""
WITH v AS (SELECT event_id AS k FROM events), f AS (SELECT k, {_sql(WINDOW_FIELDS)} FROM v), {classified_cte(D.WindowPolicy())}
SELECT k, gap_severity, continuity, visibility, state, confidence, array_to_string(codes, ',') AS reason_codes FROM z
"""

# ---- reports ----

REPORT_FIELDS = {
    "status": "CASE k % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'completed' END", "blocking": "k % 37 = 0", "analytics_completed": "k % 11 <> 0", "has_analytics": "k % 13 <> 0",
    "readiness": "CASE k % 7 WHEN 0 THEN 'UNSUITABLE' WHEN 1 THEN 'LIMITED' WHEN 2 THEN NULL WHEN 3 THEN 'EXCELLENT' ELSE 'GOOD' END", "has_signals": "k % 17 <> 0",
    "visibility": "CASE WHEN k % 19 = 0 THEN NULL ELSE (40 + k * 37 % 61) / 100.0D END", "tracked_seconds": "(k * 53 % 400) / 10.0D", "gap_ratio": "(k * 71 % 70) / 100.0D", "fragments": "1 + (k DIV 3) % 5",
    "observed_seconds": "(k * 29 % 300) / 10.0D", "zone_seconds": "(k * 31 % 50) / 10.0D", "measurement": "CASE k % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN NULL ELSE 'MODERATE' END", "observations": "k * 41 % 20",
    "unobserved": "CASE WHEN k % 2 = 0 THEN 0 ELSE (k * 43 % 30) / 10.0D END", "insights": "k % 4", "action": "CASE WHEN k % 3 = 0 THEN NULL ELSE 'review' END",
}


def _reports(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS owner")
    return rows.selectExpr("k", "owner", *[f"{t} AS {n}" for n, t in REPORT_FIELDS.items()])


_REPORTS = f"rp AS (SELECT k, owner, {_sql(REPORT_FIELDS)} FROM (SELECT o_orderkey AS k, o_custkey AS owner FROM orders))"
_CONTRIBUTIONS = f"""{_REPORTS},
wk AS (SELECT *, list_filter([CASE WHEN visibility IS NULL THEN 'MISSING_OBSERVATION_COVERAGE' END, CASE WHEN visibility < 0.65 THEN 'INSUFFICIENT_OBSERVATION_COVERAGE' END,
    CASE WHEN tracked_seconds < 5 THEN 'INSUFFICIENT_USABLE_DURATION' END, CASE WHEN gap_ratio > 0.5 THEN 'FRAGMENTED_PLAYER_TRACKING' END, CASE WHEN fragments > 3 THEN 'TOO_MANY_TRACK_FRAGMENTS' END,
    CASE WHEN observed_seconds <= 0 THEN 'MISSING_RELIABLE_OBSERVATION' END, CASE WHEN zone_seconds <= 0 THEN 'MISSING_MOVEMENT_MEASUREMENTS' END,
    CASE WHEN measurement IN ('LOW', 'NOT_AVAILABLE') THEN 'WEAK_MEASUREMENT_CONFIDENCE' END], lambda x: x IS NOT NULL) AS weak FROM rp),
st AS (SELECT *, CASE WHEN status = 'failed' THEN 1 WHEN readiness = 'UNSUITABLE' OR (readiness IS NOT NULL AND blocking) THEN 2 WHEN status IN ('pending', 'processing') THEN 3 WHEN NOT analytics_completed THEN 4
    WHEN NOT has_analytics THEN 5 WHEN readiness IS NULL OR NOT has_signals THEN 6 WHEN len(weak) > 0 THEN 7 ELSE 8 END AS step FROM wk),
ct AS (SELECT *, ['EXCLUDED', 'EXCLUDED', 'PROVISIONAL', 'PROVISIONAL', 'NOT_EVALUATED', 'NOT_EVALUATED', 'EXCLUDED', 'INCLUDED'][step] AS contribution,
    CASE step WHEN 1 THEN 'ANALYSIS_FAILED' WHEN 2 THEN 'UNSUITABLE_RECORDING,BLOCKING_EVIDENCE_FAILURE' WHEN 3 THEN 'ANALYSIS_IN_PROGRESS' WHEN 4 THEN 'ANALYSIS_INCOMPLETE' WHEN 5 THEN 'LEGACY_ANALYTICS_UNAVAILABLE'
      WHEN 6 THEN 'LEGACY_EVIDENCE_UNAVAILABLE' WHEN 7 THEN array_to_string(weak, ',') ELSE 'EVIDENCE_STANDARD_MET' END AS codes FROM st)"""


def report_contributions(spark, sf_dir):
    out = D.history_labels(D.contributions(_reports(spark, sf_dir)))
    return out.select("k", "contribution", F.array_join("contribution_codes", ",").alias("codes"), "history_status", "limitation")


CONTRIBUTION_SQL = f"""
WITH {_CONTRIBUTIONS}
SELECT k, contribution, codes, CASE WHEN status = 'failed' THEN 'FAILED' WHEN readiness = 'UNSUITABLE' THEN 'UNSUITABLE' WHEN status IN ('pending', 'processing') THEN 'PROCESSING' WHEN readiness = 'LIMITED' THEN 'LIMITED'
    WHEN status = 'completed' AND analytics_completed THEN 'READY' ELSE 'LEGACY' END AS history_status,
  CASE WHEN status = 'failed' THEN 'failed' WHEN readiness = 'UNSUITABLE' THEN 'unsuitable' WHEN readiness = 'LIMITED' THEN 'limited' END AS limitation FROM ct
"""


def trend_verdicts(spark, sf_dir):
    """Per owner the verdicts on a trend: completed reports count, those with analytics are comparable."""
    rows = _reports(spark, sf_dir).where("status = 'completed'").groupBy("owner").agg(
        F.count(F.lit(1)).alias("qualified"),
        F.count_if("has_analytics").alias("comparable"),
        F.count_distinct(F.when(F.col("has_analytics"), F.col("k") % 50 == 0)).alias("versions"),
        F.count_if(F.col("has_analytics") & (F.col("k") % 3 == 0)).alias("provisional"),
        F.coalesce(F.bool_or(F.col("has_analytics") & (F.col("k") % 4 != 0)), F.lit(False)).alias("has_metrics"),
    )
    return D.trend_eligibility(rows).select("owner", "qualified", "comparable", "trend", "baseline", "interpretation", "readiness_text")


TREND_SQL = f"""
WITH {_REPORTS}, a AS (SELECT owner, count(*) AS qualified, count(*) FILTER (has_analytics) AS comparable, count(DISTINCT k % 50 = 0) FILTER (has_analytics) AS versions,
    count(*) FILTER (has_analytics AND k % 3 = 0) AS provisional, bool_or(has_analytics AND k % 4 <> 0) AS has_metrics FROM rp WHERE status = 'completed' GROUP BY owner),
t AS (SELECT *, CASE WHEN comparable = 0 OR versions > 1 OR comparable < 3 THEN 'INELIGIBLE' WHEN comparable = 3 THEN 'PROVISIONAL' WHEN provisional > 0 THEN 'PROVISIONAL' ELSE 'ELIGIBLE' END AS trend FROM a),
b AS (SELECT *, CASE WHEN comparable < 3 THEN CASE WHEN qualified >= 3 THEN 'MIXED_OR_INCOMPATIBLE_REPORTS' ELSE 'BUILDING_BASELINE' END WHEN comparable = 3 THEN 'BASELINE_ESTABLISHED'
    WHEN trend = 'INELIGIBLE' THEN 'MIXED_OR_INCOMPATIBLE_REPORTS' ELSE 'COMPARISON_AVAILABLE' END AS baseline FROM t)
SELECT owner, qualified, comparable, trend, baseline, CASE WHEN trend = 'INELIGIBLE' THEN 'NOT_EVALUATED' WHEN NOT has_metrics THEN 'INELIGIBLE' ELSE 'PROVISIONAL' END AS interpretation,
  baseline || ': ' || comparable || ' of 3' AS readiness_text FROM b
"""


def insight_gates(spark, sf_dir):
    out = D.insight_gate(_reports(spark, sf_dir))
    return out.select(
        "k", "gate", "recording_confidence", "tracking_confidence", "measurement_confidence", "interpretation_confidence", "recommendation_confidence", "insufficient_reason",
        F.array_join("limitations", ",").alias("limitations"), "summary", "focus",
    )


GATE_SQL = f"""
WITH {_REPORTS}, g AS (SELECT *, CASE WHEN observations < 3 OR zone_seconds < 1 OR coalesce(readiness, '') = 'UNSUITABLE' THEN 'INSUFFICIENT_EVIDENCE'
    WHEN coalesce(readiness, '') = 'LIMITED' OR fragments > 1 OR unobserved > 0 OR observed_seconds < 15 THEN 'MEASUREMENT_ONLY' WHEN readiness IS NULL OR readiness = 'GOOD' THEN 'CAUTIOUS' ELSE 'NORMAL' END AS gate FROM rp),
r AS (SELECT *, CASE WHEN gate IN ('NORMAL', 'CAUTIOUS') THEN 'MODERATE' ELSE 'NOT_AVAILABLE' END AS reading FROM g)
SELECT k, gate, CASE readiness WHEN 'EXCELLENT' THEN 'HIGH' WHEN 'GOOD' THEN 'MODERATE' ELSE CASE WHEN readiness IS NULL THEN 'NOT_AVAILABLE' ELSE 'LOW' END END AS recording_confidence,
  CASE WHEN fragments = 1 AND unobserved = 0 THEN 'MODERATE' ELSE 'LOW' END AS tracking_confidence, CASE WHEN observations >= 3 AND zone_seconds >= 1 THEN 'MODERATE' ELSE 'LOW' END AS measurement_confidence,
  reading AS interpretation_confidence, reading AS recommendation_confidence,
  CASE WHEN readiness = 'UNSUITABLE' THEN 'unsuitable_recording' WHEN observations < 3 THEN 'few_observations' WHEN zone_seconds < 1 THEN 'little_tracked_time' END AS insufficient_reason,
  concat_ws(',', CASE WHEN unobserved > 0 THEN 'unobserved_gap' END, CASE WHEN fragments > 1 THEN 'several_fragments' END, CASE WHEN readiness IS NULL THEN 'legacy_recording' END) AS limitations,
  CASE WHEN gate = 'MEASUREMENT_ONLY' THEN 'suppressed' WHEN insights = 1 THEN '1 observation' WHEN insights > 1 THEN insights || ' observations' ELSE 'none' END AS summary,
  CASE WHEN reading = 'MODERATE' AND insights > 0 THEN action END AS focus FROM r
"""

# ---- recordings ----

RECORDING_FIELDS = {
    "width": "CASE k % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 854 ELSE 600 END", "height": "CASE k % 4 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 480 ELSE 900 END - CASE WHEN k % 5 = 0 THEN 200 ELSE 0 END",
    "fps": "CASE k % 3 WHEN 0 THEN 30 WHEN 1 THEN 60 ELSE k % 31 END", "duration": "CASE WHEN k % 2 = 0 THEN 90 ELSE k * 7 % 100 END",
    "calibrated": "k % 17 <> 0", "people": "k % 13", "selectable": "k % 11", "quality": "CASE WHEN k % 3 = 0 THEN 'USABLE' ELSE 'STRONG' END", "visibility": "(60 + k * 37 % 41) / 100.0D", "tracked": "CASE WHEN k % 4 = 0 THEN 45.0D ELSE (k * 53 % 400) / 10.0D END",
    "span": "CASE WHEN k % 4 = 0 THEN 46.0D ELSE (k * 53 % 400) / 10.0D + k % 9 END", "fragments": "CASE WHEN k % 4 = 0 THEN 1 ELSE 1 + (k DIV 3) % 5 END",
}


def recording_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey DIV 3 AS k").distinct().selectExpr("k", *[f"{t} AS {n}" for n, t in RECORDING_FIELDS.items()])
    upload = D.recording_checks(rows)
    upload = upload.select("*", F.array_join("failures", ",").alias("upload_failures"), F.array_join("warnings", ",").alias("upload_warnings")).withColumnRenamed("level", "upload").drop("failures", "warnings")
    return D.readiness_checks(upload).select("k", "resolution", "upload", "upload_failures", "upload_warnings", "level", F.array_join("reason_codes", ",").alias("reason_codes"))


RECORDING_SQL = f"""
WITH v AS (SELECT DISTINCT o_orderkey // 3 AS k FROM orders), f AS (SELECT k, {_sql(RECORDING_FIELDS)} FROM v), e AS (SELECT *, least(width, height) AS edge, greatest(0, span - tracked) / span AS g0 FROM f),
u AS (SELECT *, coalesce(g0, 0) AS gap, concat_ws(',', CASE WHEN edge < 480 THEN 'LOW_RESOLUTION' END, CASE WHEN fps < 15 THEN 'LOW_FRAME_RATE' END, CASE WHEN duration < 10 THEN 'TOO_SHORT' END) AS upload_failures,
    concat_ws(',', CASE WHEN height > width THEN 'VERTICAL_VIDEO' END, CASE WHEN edge >= 480 AND edge < 720 THEN 'REDUCED_RESOLUTION' END, CASE WHEN fps >= 15 AND fps < 24 THEN 'REDUCED_FRAME_RATE' END) AS upload_warnings FROM e),
l AS (SELECT *, CASE WHEN upload_failures <> '' THEN 'UNSUITABLE' WHEN upload_warnings <> '' THEN 'LIMITED' WHEN edge >= 1080 AND fps >= 30 AND duration >= 60 THEN 'EXCELLENT' ELSE 'GOOD' END AS upload FROM u),
c AS (SELECT *, concat_ws(',', CASE WHEN upload = 'UNSUITABLE' THEN 'UPLOAD_UNSUITABLE' END, CASE WHEN NOT calibrated THEN 'CALIBRATION_MISSING' END, CASE WHEN people = 0 THEN 'NO_PEOPLE' END,
    CASE WHEN selectable = 0 THEN 'NO_SELECTABLE_PLAYER' END, CASE WHEN visibility < 0.65 THEN 'LOW_VISIBILITY' END, CASE WHEN tracked < 5 THEN 'SHORT_TRACK' END, CASE WHEN gap > 0.5 THEN 'LARGE_GAPS' END,
    CASE WHEN fragments > 3 THEN 'MANY_FRAGMENTS' END) AS ff,
  concat_ws(',', CASE WHEN upload = 'LIMITED' THEN 'UPLOAD_LIMITED' END, CASE WHEN quality <> 'STRONG' THEN 'CANDIDATE_NOT_STRONG' END, CASE WHEN tracked >= 5 AND tracked < 30 THEN 'REDUCED_TRACK' END,
    CASE WHEN gap <= 0.5 AND (gap > 0.1 OR fragments > 1) THEN 'TRACKING_GAPS' END) AS ww FROM l)
SELECT k, CASE WHEN edge >= 1080 THEN '1080p' WHEN edge >= 720 THEN '720p' END AS resolution, upload, upload_failures, upload_warnings,
  CASE WHEN ff <> '' THEN 'UNSUITABLE' WHEN ww <> '' THEN 'LIMITED' WHEN upload = 'EXCELLENT' AND tracked >= 30 AND visibility >= 0.85 AND gap <= 0.1 AND fragments = 1 THEN 'EXCELLENT' ELSE 'GOOD' END AS level,
  concat_ws(',', nullif(ff, ''), nullif(ww, '')) AS reason_codes FROM c
"""

# ---- metrics of review counts ----


def review_metrics(spark, sf_dir):
    """Per order priority: availability and text of a count metric, weakest confidence and visibility of the group."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS priority", "o_orderstatus AS status", "o_orderkey AS k")
    rows = rows.withColumn("confidence", F.when(F.col("k") % 7 == 0, "HIGH").when(F.col("k") % 7 < 5, "MODERATE").otherwise("LOW"))
    out = rows.groupBy("priority", (F.col("k") % 40).alias("part")).agg(
        F.count_if((F.col("status") == "F") & (F.col("k") % 3 == 0)).alias("numerator"), F.count_if(F.col("k") % 3 == 0).alias("denominator"), F.count(F.lit(1)).alias("samples"),
        D.ordinal_least(F.col("confidence"), ["NOT_AVAILABLE", "LOW", "MODERATE", "HIGH"]).alias("weakest"),
    )
    return out.withColumns(D.count_metric(F.col("numerator"), F.col("denominator"), F.col("samples"), least=12))


REVIEW_SQL = """
WITH a AS (SELECT o_orderpriority AS priority, o_orderkey % 40 AS part, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS numerator, count(*) FILTER (o_orderkey % 3 = 0) AS denominator, count(*) AS samples,
    CASE min(CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 7 < 5 THEN 2 ELSE 1 END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MODERATE' ELSE 'HIGH' END AS weakest FROM orders GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN denominator = 0 THEN 'NOT_REVIEWED' WHEN samples < 12 THEN 'PROVISIONAL' ELSE 'AVAILABLE' END AS availability FROM a)
SELECT priority, part, numerator, denominator, samples, weakest, availability, CASE WHEN availability = 'AVAILABLE' THEN p END AS percent,
  numerator || '/' || denominator || ' (' || coalesce(printf('%.1f%%', p), 'not available') || ')' || CASE WHEN samples < 12 THEN ' — provisional' ELSE '' END AS text
FROM (SELECT *, round_even(numerator / nullif(denominator, 0)::DOUBLE * 100, 1) AS p FROM b)
"""

# ---- scalars ----


def geometry_scalars(spark, sf_dir):
    n = lambda k, m: ((F.col("event_id") * k) % m).cast("double")
    rows = table(spark, sf_dir, "events").select("event_id", n(7, 41).alias("x1"), n(11, 43).alias("y1"), n(13, 47).alias("x2"), n(17, 53).alias("y2"), n(19, 59).alias("x3"), n(23, 61).alias("y3"), n(29, 67).alias("x4"), n(31, 71).alias("y4"))
    a, b, p, q = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in (1, 2, 3, 4)]
    foot = S.ground_point(a[0], b[0], b[1])
    px, py = S.court_pixel(a[0] / 2, a[1], 640, 960, 20, (20.0, 44.0))
    return rows.select(
        "event_id", foot[0].alias("foot_x"), foot[1].alias("foot_y"), S.cross(a, b, p).alias("turn"), S.segments_cross(a, b, p, q).alias("crosses"), S.segments_touch(a, b, p, q).alias("touches"),
        S.polygon_area([a, b, p, q]).alias("area"), px.cast("long").alias("pixel_x"), py.cast("long").alias("pixel_y"), F.round(S.weighted_mean(a[0], b[0], a[1], b[1]), 9).alias("mean"),
        F.round(S.clamp(a[0] / 40 - b[0] / 50), 9).alias("clamped"), F.round(S.least_over_most(a[0], b[0]), 9).alias("ratio"), F.round(S.court_score(a[0] / 30, a[1] / 50, b[0] / 40), 9).alias("score"),
        F.round(S.ball_confidence(a[0] / 41, a[1] / 43, b[0] / 47, b[1] / 53), 9).alias("ball"), F.round(S.mean_point_error([a, b], [p, q]), 9).alias("error"),
    )


GEOMETRY_SQL = """
WITH r AS (SELECT event_id, (event_id * 7 % 41)::DOUBLE AS x1, (event_id * 11 % 43)::DOUBLE AS y1, (event_id * 13 % 47)::DOUBLE AS x2, (event_id * 17 % 53)::DOUBLE AS y2, (event_id * 19 % 59)::DOUBLE AS x3,
    (event_id * 23 % 61)::DOUBLE AS y3, (event_id * 29 % 67)::DOUBLE AS x4, (event_id * 31 % 71)::DOUBLE AS y4 FROM events),
t AS (SELECT *, (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) AS t1, (x2 - x1) * (y4 - y1) - (y2 - y1) * (x4 - x1) AS t2, (x4 - x3) * (y1 - y3) - (y4 - y3) * (x1 - x3) AS t3,
    (x4 - x3) * (y2 - y3) - (y4 - y3) * (x2 - x3) AS t4 FROM r)
SELECT event_id, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, t1 AS turn, t1 * t2 < 0 AND t3 * t4 < 0 AS crosses, sign(t1) <> sign(t2) AND sign(t3) <> sign(t4) AS touches,
  abs((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2 AS area,
  round_even(20 + x1 / 2 / 20::DOUBLE * 600, 0)::BIGINT AS pixel_x, round_even(940 - y1 / 44::DOUBLE * 920, 0)::BIGINT AS pixel_y,
  round(coalesce((x1 * x2 + y1 * y2) / nullif(x2 + y2, 0), 0), 9) AS mean, round(greatest(0, least(1, x1 / 40 - x2 / 50)), 9) AS clamped,
  round(CASE WHEN greatest(x1, x2) <= 0 THEN 0 ELSE least(x1, x2) / greatest(x1, x2) END, 9) AS ratio,
  round(0.2::DOUBLE + 0.55::DOUBLE * least(1, x1 / 30) + 0.15::DOUBLE * least(1, y1 / 50) + 0.1::DOUBLE * least(1, x2 / 40), 9) AS score,
  round(0.3::DOUBLE * (x1 / 41) + 0.25::DOUBLE * (y1 / 43) + 0.3::DOUBLE * (x2 / 47) + 0.15::DOUBLE * (y2 / 53), 9) AS ball,
  round((sqrt((x1 - x3) * (x1 - x3) + (y1 - y3) * (y1 - y3)) + sqrt((x2 - x4) * (x2 - x4) + (y2 - y4) * (y2 - y4))) / 2, 9) AS error FROM t
"""

KINDS = {"tracks": "TRACKS", "reports": "REPORT", "frames": "FRAME"}
REASONS = ["too_short", "off_court"]


def name_scalars(spark, sf_dir):
    k, s = F.col("k"), lambda c: c.cast("string")
    wide = k.cast("decimal(12,0)")  # a long holds the cubes of keys up to 2,097,151 only
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))
    folder = F.when(k % 4 == 0, "tracks").when(k % 4 == 1, "reports").when(k % 4 == 2, "frames").otherwise("misc")
    rows = rows.withColumn("key", F.concat(folder, F.lit("/frame_"), F.lpad(s(k % 1000000), 6, "0"), F.when(k % 3 == 0, F.concat(F.lit(".v"), s(k % 9 + 1), F.lit(".json"))).otherwise(".jpg")))
    name = F.concat(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("My-clip_"), s(k))), F.lit(".mp4"))
    reason = F.when(k % 3 == 0, " Too short ").when(k % 3 == 1, "OFF COURT").otherwise("odd")
    seconds = (k % 4001) / F.lit(4.0) - 20
    direction = F.when(k % 13 > 0, F.when(F.abs(k % 21 - 10) < 5, "STABLE").when(k % 21 > 10, "HIGHER").otherwise("LOWER"))
    return rows.select(
        "k", S.artifact_kind(F.col("key"), KINDS).alias("kind"), S.name_version(F.col("key")).alias("version"), S.frame_number(F.col("key")).alias("frame"), S.title(name, F.col("digest")).alias("title"),
        S.safe_stem(F.concat(F.lit("_a b*"), F.col("priority"), F.lit("."))).alias("stem"), S.structured_reason(reason, REASONS, "other").alias("reason"), S.attempt_prefix(F.lit("TRACKING"), k % 20000).alias("prefix"),
        S.short_id(F.when(k % 2 == 0, F.col("digest")).otherwise(s(k))).alias("short"), S.duration_text(seconds).alias("duration"), S.size_text(wide * wide * wide).alias("size"),
        S.change_label(direction, (k % 21 - 10) / F.lit(4.0), F.when(k % 2 == 0, "%").otherwise("ft")).alias("change"),
        S.distance_text(F.when(k % 17 > 0, (k % 997) / F.lit(8.0))).alias("distance"), S.tracked_time_text(F.when(k % 19 > 0, (k % 997) / F.lit(8.0))).alias("tracked"), S.capacity_state(k * 10, F.lit(5000), 50_000, 10_000).alias("capacity"),
    )


NAME_SQL = r"""
WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS priority, sha256(o_orderkey::VARCHAR) AS digest,
    ['tracks', 'reports', 'frames', 'misc'][o_orderkey % 4 + 1] || '/frame_' || right('000000' || (o_orderkey % 1000000), 6) || CASE WHEN o_orderkey % 3 = 0 THEN '.v' || (o_orderkey % 9 + 1) || '.json' ELSE '.jpg' END AS key,
    greatest(0, floor((o_orderkey % 4001) / 4.0 - 20 + 0.5)::BIGINT) AS w, o_orderkey * o_orderkey * o_orderkey AS z, (o_orderkey % 997) / 8::DOUBLE AS t FROM orders)
SELECT k, CASE WHEN key LIKE 'tracks/%' THEN 'TRACKS' WHEN key LIKE 'reports/%' THEN 'REPORT' WHEN key LIKE 'frames/%' THEN 'FRAME' ELSE 'OTHER' END AS kind,
  CASE WHEN k % 3 = 0 THEN k % 9 + 1 END AS version, CASE WHEN k % 3 <> 0 THEN k % 1000000 END AS frame, CASE WHEN k % 5 = 0 THEN left(digest, 8) ELSE 'My clip ' || k END AS title,
  regexp_replace(regexp_replace('_a b*' || priority || '.', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS stem, ['too_short', 'off_court', 'other'][k % 3 + 1] AS reason,
  'tracking/attempt-' || lpad((k % 20000)::VARCHAR, greatest(4, length((k % 20000)::VARCHAR))::INTEGER, '0') AS prefix, CASE WHEN k % 2 = 0 THEN left(digest, 8) || '...' || right(digest, 4) ELSE k::VARCHAR END AS short,
  CASE WHEN w >= 60 THEN w // 60 || 'm ' || w % 60 || 's' ELSE w || 's' END AS duration,
  CASE WHEN z < 1024 THEN z || ' B' WHEN z < 1048576 THEN printf('%.1f KB', round(z / 1024::DOUBLE, 1)) WHEN z < 1073741824 THEN printf('%.1f MB', round(z / 1048576::DOUBLE, 1)) ELSE printf('%.2f GB', round(z / 1073741824::DOUBLE, 2)) END AS size,
  CASE WHEN k % 13 = 0 THEN 'Unavailable' WHEN abs(k % 21 - 10) < 5 THEN 'Remained similar' ELSE CASE WHEN k % 21 > 10 THEN 'Increased by ' ELSE 'Decreased by ' END
    || printf('%.1f', round(abs(k % 21 - 10) / 4::DOUBLE, 1)) || CASE WHEN k % 2 = 0 THEN '%' ELSE ' ft' END END AS change,
  CASE WHEN k % 17 = 0 THEN 'Unavailable' ELSE printf('%.1f ft', round(t, 1)) END AS distance,
  CASE WHEN k % 19 = 0 THEN 'Unavailable' WHEN t < 60 THEN printf('%.1f sec', round(t, 1)) ELSE printf('%.1f min', round(t / 60, 1)) END AS tracked,
  CASE WHEN k * 10 - 5000 < 10000 THEN 'hard_stop' WHEN k * 10 - 5000 < 50000 THEN 'warning' ELSE 'available' END AS capacity FROM r
"""

QUERIES = {f.__name__: f for f in (window_classifier, report_contributions, trend_verdicts, insight_gates, recording_checks, review_metrics, geometry_scalars, name_scalars)}
ORACLES = dict(zip(QUERIES, (WINDOW_SQL, CONTRIBUTION_SQL, TREND_SQL, GATE_SQL, RECORDING_SQL, REVIEW_SQL, GEOMETRY_SQL, NAME_SQL)))
