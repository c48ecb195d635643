"""Queries over the checks of stored data and the decisions on candidates, each with the DuckDB statement that checks it where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import invariants as I
from ..operators import tracks as T
from ..session import table
from ..sources.observations import OBS_SQL, observations
from .decision_queries import _CONTRIBUTIONS, _reports, _sql
from .movement_queries import COURT, FRAGMENTS_CTE, POLICY

#: Limits that fit events days apart.
EVENT_MERGE = I.MergePolicy(max_gap=432_000.0, max_speed=2e-4)


def merge_validation(spark, sf_dir):
    """Whether a player's track can be merged with its next one and with those of the neighbouring player; six hours are a frame."""
    obs = observations(spark, sf_dir)
    own = T.fragments(obs, COURT, POLICY).select("track_id", "side")
    pairs = own.select(F.col("track_id").alias("first_id"), F.col("side").alias("first_side"), F.explode(F.array(*[F.col("track_id") + k for k in (1, 100, 101)])).alias("second_id"))
    pairs = pairs.join(own.select(F.col("track_id").alias("second_id"), F.col("side").alias("second_side")), "second_id")
    frames = obs.select(F.col("track_id").alias("group_id"), F.expr("ts_us div 21600000000").alias("frame_index"), "ts_us", "court_x", "court_y")
    return I.merge_problems(pairs, frames, EVENT_MERGE)


MERGE_SQL = f"""
WITH {OBS_SQL}, {FRAGMENTS_CTE},
pr AS (SELECT a.track_id AS first_id, b.track_id AS second_id, a.side AS s1, b.side AS s2 FROM fr a JOIN fr b ON b.track_id = a.track_id + 1 OR b.track_id = a.track_id + 100 OR b.track_id = a.track_id + 101),
fm AS (SELECT DISTINCT track_id, ts_us // 21600000000 AS f FROM obs),
sh AS (SELECT first_id, second_id, count(*) AS shared FROM pr JOIN fm x ON x.track_id = first_id JOIN fm y ON y.track_id = second_id AND y.f = x.f GROUP BY 1, 2),
oo AS (SELECT track_id, ts_us, court_x AS x, court_y AS y, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, court_x, court_y) AS k, count(*) OVER (PARTITION BY track_id) AS m FROM obs),
en AS (SELECT track_id, min(ts_us) AS f, max(ts_us) AS l, count(DISTINCT ts_us // 21600000000) AS n, max(x) FILTER (k = 1) AS fx, max(y) FILTER (k = 1) AS fy, max(x) FILTER (k = m) AS lx, max(y) FILTER (k = m) AS ly FROM oo GROUP BY 1),
jn AS (SELECT pr.*, coalesce(shared, 0) AS shared, least(a.n, b.n) AS n, CASE WHEN a.f <= b.f THEN b.f - a.l ELSE a.f - b.l END / 1000000.0::DOUBLE AS gap,
    CASE WHEN a.f <= b.f THEN sqrt(pow(a.lx - b.fx, 2) + pow(a.ly - b.fy, 2)) ELSE sqrt(pow(b.lx - a.fx, 2) + pow(b.ly - a.fy, 2)) END AS way
  FROM pr JOIN en a ON a.track_id = first_id JOIN en b ON b.track_id = second_id LEFT JOIN sh USING (first_id, second_id))
SELECT first_id, second_id, shared, CASE WHEN shared >= 3 OR shared / n::DOUBLE > 0.1::DOUBLE THEN 'SAME_TIME' WHEN s1 <> s2 AND s1 <> 'UNKNOWN' AND s2 <> 'UNKNOWN' THEN 'OPPOSITE_SIDES' WHEN gap < 0 THEN 'OVERLAP'
  WHEN gap > 432000 THEN 'LONG_GAP' WHEN way / greatest(gap, 1.0::DOUBLE / 30) > 2e-4::DOUBLE THEN 'IMPLAUSIBLE_SPEED' END AS problem FROM jn
"""


def box_constraints(spark, sf_dir):
    """Boxes derived from events that break a constraint, with the codes."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 53 = 0 THEN double('NaN') WHEN event_id % 59 = 0 THEN double('Infinity') WHEN event_id % 61 <> 0 THEN double(event_id % 640) END AS x1", "double(event_id % 480) AS y1",
        "double(event_id % 640 + event_id * 13 % 40 - 3) AS x2", "double(event_id % 480 + event_id * 17 % 50 - 3) AS y2",
    )
    return e.withColumn("problems", I.box_problems()).where(F.size("problems") > 0).select("event_id", F.array_join("problems", ",").alias("problems"))


BOX_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 53 = 0 OR event_id % 59 = 0 OR event_id % 61 = 0 THEN false ELSE true END AS ok, event_id * 13 % 40 - 3 AS w, event_id * 17 % 50 - 3 AS h FROM events)
SELECT event_id, CASE WHEN NOT ok THEN 'NOT_FINITE' WHEN w <= 0 AND h <= 0 THEN 'NO_WIDTH,NO_HEIGHT' WHEN w <= 0 THEN 'NO_WIDTH' ELSE 'NO_HEIGHT' END AS problems FROM e WHERE NOT ok OR w <= 0 OR h <= 0
"""


def interval_overlaps(spark, sf_dir):
    """Orders taken as intervals of 0 to 39 days that start before the customer's one before them ends."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "unix_date(CAST(o_orderdate AS DATE)) AS start_day")
    o = o.withColumn("end_day", (F.col("start_day") + F.col("o_orderkey") % 40).cast("long"))
    return I.overlapping(o, ["o_custkey"], "start_day", "end_day", ["o_orderkey"]).select("o_custkey", "o_orderkey", "previous_end")


OVERLAP_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE - DATE '1970-01-01' AS s, o_orderdate::DATE - DATE '1970-01-01' + o_orderkey % 40 AS e FROM orders),
p AS (SELECT *, lag(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS previous_end FROM o)
SELECT o_custkey, o_orderkey, previous_end FROM p WHERE s < previous_end
"""


def frame_order(spark, sf_dir):
    """Order dates that are not above the one before them, customers' orders taken by key."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "unix_date(CAST(o_orderdate AS DATE)) AS day")
    return I.not_increasing(o, ["o_custkey"], ["o_orderkey"], "day").select("o_custkey", "o_orderkey", "day", "previous")


FRAME_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE - DATE '1970-01-01' AS day FROM orders), p AS (SELECT *, lag(day) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM o)
SELECT * FROM p WHERE previous >= day
"""

CANDIDATE_FIELDS = {
    "analysis_id": "k % 40", "quality": "CASE k % 7 WHEN 0 THEN 'WEAK' WHEN 1 THEN NULL WHEN 2 THEN 'USABLE' ELSE 'STRONG' END", "inside_ratio": "(CASE WHEN k % 3 = 0 THEN k * 37 % 100 ELSE 80 END) / 100.0D",
    "movement_rate": "(CASE WHEN k % 5 = 0 THEN k * 41 % 100 ELSE 90 END) / 100.0D", "fragments": "1 + (k DIV 3) % 4", "seconds": "(k * 29 % 60) / 10.0D",
}


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k", *[f"{t} AS {n}" for n, t in CANDIDATE_FIELDS.items()])


_CANDIDATES = f"""
ca AS (SELECT k, {_sql(CANDIDATE_FIELDS)} FROM (SELECT o_orderkey AS k FROM orders)),
rs AS (SELECT *, list_filter([CASE WHEN coalesce(quality, 'WEAK') = 'WEAK' THEN 'uncertain_player_candidate' END, CASE WHEN inside_ratio < 0.65 THEN 'mostly_outside_detected_court' END,
    CASE WHEN movement_rate < 0.5 THEN 'limited_court_movement' END, CASE WHEN fragments > 3 THEN 'excessive_track_fragmentation' END], lambda x: x IS NOT NULL) AS reasons FROM ca)"""


def candidate_eligibility(spark, sf_dir):
    """Candidates with the reasons against them: the first four without one, as they are stored, are eligible."""
    out = I.stored_selection(_candidates(spark, sf_dir), ["analysis_id"], ["k"])
    return out.select("analysis_id", "k", "eligible", F.array_join("reasons", ",").alias("reasons"), F.coalesce(I.reliable(), F.lit(False)).alias("reliable"))


ELIGIBLE_SQL = f"""
WITH {_CANDIDATES}, pl AS (SELECT *, sum((len(reasons) = 0)::INTEGER) OVER (PARTITION BY analysis_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS place FROM rs)
SELECT analysis_id, k, len(reasons) = 0 AND place <= 4 AS eligible, CASE WHEN len(reasons) = 0 AND place > 4 THEN 'outside_top_four_court_players' ELSE array_to_string(reasons, ',') END AS reasons,
  coalesce(quality <> 'WEAK' AND inside_ratio >= 0.3 AND seconds >= 1 AND fragments <= 3, false) AS reliable FROM pl
"""


def candidate_actions(spark, sf_dir):
    """Candidates after the actions on them: rejected ones are out until restored, the last choice of an analysis holds. Each has two actions, which may be none."""
    own = _candidates(spark, sf_dir).withColumn("eligible", F.size(I.exclusion_reasons()) == 0)
    what = "CASE WHEN k % 3 > 0 THEN 'NONE' WHEN (k DIV 3) % 4 = 0 THEN 'REJECT' WHEN (k DIV 3) % 4 = 2 THEN 'RESTORE' ELSE 'SELECT' END AS action"
    actions = own.selectExpr("analysis_id", "k", what, "k * 31 % 100003 * 2 AS number")
    later = own.selectExpr("analysis_id", "k", "CASE WHEN k % 6 > 0 THEN 'NONE' WHEN k % 4 = 0 THEN 'REJECT' ELSE 'RESTORE' END AS action", "k * 17 % 100003 * 2 + 1 AS number")
    return I.selected(own, ["analysis_id"], "k", actions.unionByName(later)).select("analysis_id", "k", "status")


ACTIONS_SQL = f"""
WITH {_CANDIDATES}, ac AS (SELECT analysis_id, k, CASE WHEN k % 3 > 0 THEN 'NONE' WHEN (k // 3) % 4 = 0 THEN 'REJECT' WHEN (k // 3) % 4 = 2 THEN 'RESTORE' ELSE 'SELECT' END AS action, k * 31 % 100003 * 2 AS number FROM ca
  UNION ALL SELECT analysis_id, k, CASE WHEN k % 6 > 0 THEN 'NONE' WHEN k % 4 = 0 THEN 'REJECT' ELSE 'RESTORE' END, k * 17 % 100003 * 2 + 1 FROM ca),
mv AS (SELECT analysis_id, k, action AS moved FROM ac WHERE action IN ('REJECT', 'RESTORE') QUALIFY row_number() OVER (PARTITION BY analysis_id, k ORDER BY number DESC) = 1),
rj AS (SELECT analysis_id, k, max(number) AS rejected_at FROM ac WHERE action = 'REJECT' GROUP BY 1, 2),
ch AS (SELECT analysis_id, k AS chosen, number AS chosen_at FROM ac WHERE action = 'SELECT' QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY number DESC, k DESC) = 1)
SELECT rs.analysis_id, rs.k, CASE WHEN len(reasons) > 0 OR coalesce(moved, '') = 'REJECT' THEN 'EXCLUDED' WHEN chosen = rs.k AND coalesce(rejected_at, -1) < chosen_at THEN 'SELECTED' ELSE 'PENDING' END AS status
FROM rs LEFT JOIN mv USING (analysis_id, k) LEFT JOIN rj USING (analysis_id, k) LEFT JOIN ch ON ch.analysis_id = rs.analysis_id
"""


def report_comparability(spark, sf_dir):
    """Reports with whether they can be compared, and the limits of that."""
    rows = D.contributions(_reports(spark, sf_dir))
    rows = rows.withColumns({"tracking": F.expr("CASE k % 6 WHEN 0 THEN 'LOW' WHEN 1 THEN NULL ELSE 'MODERATE' END")})
    out = D.comparability(rows)
    return out.select("k", "comparability", F.array_join("comparability_limits", ",").alias("limits"))


COMPARABLE_SQL = f"""
WITH {_CONTRIBUTIONS}, t AS (SELECT *, CASE k % 6 WHEN 0 THEN 'LOW' WHEN 1 THEN NULL ELSE 'MODERATE' END AS tracking FROM ct),
v AS (SELECT *, CASE contribution WHEN 'PROVISIONAL' THEN 'PROVISIONAL' WHEN 'NOT_EVALUATED' THEN 'NOT_EVALUATED' WHEN 'EXCLUDED' THEN 'INELIGIBLE' ELSE
    CASE WHEN NOT has_analytics THEN 'NOT_EVALUATED' WHEN observed_seconds <= 0 OR zone_seconds <= 0 OR coalesce(tracking, '') = 'LOW' OR coalesce(measurement, '') = 'LOW' THEN 'INELIGIBLE' ELSE 'PROVISIONAL' END END AS comparability FROM t)
SELECT k, comparability, CASE WHEN contribution = 'INCLUDED' AND comparability = 'PROVISIONAL' THEN 'match_format_unknown,camera_placement_unknown' || CASE WHEN readiness = 'LIMITED' THEN ',limited_recording' ELSE '' END
  || CASE WHEN tracking IS NULL AND measurement IS NULL THEN ',confidence_unavailable' ELSE '' END ELSE '' END AS limits FROM v
"""


def artifact_rollup(spark, sf_dir):
    """Per customer the readiness of its orders taken as artifacts, the side they are on, their versions in the order of first use, next attempt and stale runs."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey", "o_orderpriority AS version", "o_orderkey % 90 AS lease", "CASE o_orderkey % 3 WHEN 0 THEN 'processing' ELSE 'done' END AS state",
        "CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 37 = 0 THEN 'MISSING' WHEN o_orderkey % 41 = 0 THEN 'INCOMPATIBLE' WHEN o_orderkey % 43 = 0 THEN 'LEGACY' ELSE 'READY' END AS artifact",
        "CASE WHEN o_orderkey % 4 > 0 THEN 'UNKNOWN' WHEN (o_custkey + o_orderkey DIV 4 % 9 DIV 8) % 2 = 0 THEN 'NEAR' ELSE 'FAR' END AS side",
    )
    out = o.groupBy("o_custkey").agg(I.artifact_readiness("artifact").alias("readiness"), I.combined_side("side").alias("side"))
    versions = I.in_first_order(o, ["o_custkey"], ["o_orderkey"], "version")
    runs = I.attempts(o.withColumn("attempt", F.col("o_orderkey") % 8), "o_custkey", "attempt", F.lit(45))
    out = out.join(versions, "o_custkey").join(runs, "o_custkey")
    return out.select("o_custkey", "readiness", "side", F.array_join("values", ",").alias("versions"), "single", "next_attempt", "stale")


ARTIFACT_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS version, CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 37 = 0 THEN 'MISSING' WHEN o_orderkey % 41 = 0 THEN 'INCOMPATIBLE' WHEN o_orderkey % 43 = 0 THEN 'LEGACY' ELSE 'READY' END AS a,
    CASE WHEN o_orderkey % 4 > 0 THEN 'UNKNOWN' WHEN (o_custkey + o_orderkey // 4 % 9 // 8) % 2 = 0 THEN 'NEAR' ELSE 'FAR' END AS side FROM orders),
f AS (SELECT o_custkey, version, min(o_orderkey) AS first FROM o GROUP BY 1, 2), v AS (SELECT o_custkey, string_agg(version, ',' ORDER BY first) AS versions, count(*) <= 1 AS single FROM f GROUP BY 1),
g AS (SELECT o_custkey, CASE WHEN bool_and(a = 'MISSING') THEN 'MISSING' WHEN bool_or(a = 'INCOMPATIBLE') THEN 'INCOMPATIBLE' WHEN bool_or(a = 'MISSING') THEN 'PARTIAL' WHEN bool_or(a = 'LEGACY') THEN 'LEGACY' ELSE 'READY' END AS readiness,
    CASE count(DISTINCT side) FILTER (side <> 'UNKNOWN') WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN max(side) FILTER (side <> 'UNKNOWN') ELSE 'MIXED' END AS side, max(o_orderkey % 8) + 1 AS next_attempt,
    count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 90 <= 45) AS stale FROM o GROUP BY 1)
SELECT o_custkey, readiness, side, versions, single, next_attempt, stale FROM g JOIN v USING (o_custkey)
"""


def preview_rows(spark, sf_dir):
    """First, middle and last order of each customer."""
    return I.first_middle_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position")


PREVIEW_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, position FROM r WHERE position IN (0, n // 2, n - 1)
"""


def expired_folders(spark, sf_dir):
    """Players taken as folders, whose last event is before the mean of all last events, with their events and bytes of properties."""
    e = table(spark, sf_dir, "events").withColumn("bytes", F.octet_length("props").cast("long"))
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max(at).alias("last")).agg(F.sum("last").alias("s"), F.count(F.lit(1)).alias("n")).first()
    cutoff = F.lit(last["s"] // last["n"] if last["n"] else 0)
    return I.expired(e.withColumn("at", at), "user_id", "at", "bytes", cutoff).select("user_id", "files", "bytes")


EXPIRED_SQL = """
WITH l AS (SELECT user_id, floor(epoch(max(ts)))::BIGINT AS last FROM events GROUP BY 1)
SELECT user_id, count(*) AS files, sum(strlen(props))::BIGINT AS bytes FROM events JOIN l USING (user_id) WHERE last < (SELECT sum(last) // count(*) FROM l) GROUP BY 1
"""


def shared_members(spark, sf_dir):
    """Parts that more than one supplier has delivered: members of several groups."""
    return I.repeated_members(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


SHARED_SQL = "SELECT l_partkey, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1"


QUERIES = {
    f.__name__: f
    for f in (
        merge_validation, box_constraints, interval_overlaps, frame_order, candidate_eligibility, candidate_actions, report_comparability, artifact_rollup, preview_rows, expired_folders, shared_members,
    )
}
ORACLES = dict(
    zip(QUERIES, (MERGE_SQL, BOX_SQL, OVERLAP_SQL, FRAME_SQL, ELIGIBLE_SQL, ACTIONS_SQL, COMPARABLE_SQL, ARTIFACT_SQL, PREVIEW_SQL, EXPIRED_SQL, SHARED_SQL))
)
