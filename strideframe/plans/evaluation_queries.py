"""Queries over reviewed samples and configurations, each with the DuckDB statement that checks it. Orders are samples, their line items what was reviewed of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import evaluation as E
from ..session import table


def _samples(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n % len(names) + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem")
    q = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(q)).alias("lines"))  # the lines of one order
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == k, "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    p = lambda x: x["l_partkey"]
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    yes = lambda x, n: F.when(p(x) % n == 0, "NO").when(p(x) % n == 1, "NOT_REVIEWED").otherwise("YES")
    mapping = lambda x: F.struct(text("c", p(x)).alias("candidate_id"), F.when(p(x) % 2 == 0, "SPECTATOR").otherwise("COURT_PLAYER").alias("role"), F.when(p(x) % 3 > 0, text("p", x["l_suppkey"])).alias("player_id"), yes(x, 9).alias("correct"))
    interval = lambda x: F.struct(
        F.when(p(x) % 4 > 0, text("c", p(x))).alias("candidate_id"), text("p", x["l_suppkey"]).alias("player_id"), (p(x) % 40 / F.lit(4.0)).alias("start_s"), (p(x) % 40 / F.lit(4.0) + x["l_quantity"]).alias("end_s"),
        yes(x, 11).alias("identity"), F.when(p(x) % 13 == 0, "BROKEN").otherwise("CONTINUOUS").alias("continuity"))
    insight = lambda x: F.struct(text("i", p(x)).alias("insight_id"), F.when(p(x) % 2 == 0, "NORMAL").otherwise("CAUTIOUS").alias("gate"), *[yes(x, 17 + 2 * i).alias(f) for i, f in enumerate(E.INSIGHT_FIELDS)])
    some = lambda n, f: F.when(k % n == 0, F.transform("lines", f))
    return rows.select(
        text("s", k).alias("sample_id"), F.col("o_orderstatus").alias("status"), pick(5, "STRONG", "USABLE", "LIMITED").alias("system_quality"), pick(7, "STRONG", "USABLE").alias("expected_quality"), (k % 5 - 2).cast("int").alias("quality_delta"),
        F.when(k % 3 > 0, pick(11, "NORMAL", "CAUTIOUS", "INSUFFICIENT_EVIDENCE")).alias("system_gate"), pick(13, "NORMAL", "INSUFFICIENT_EVIDENCE", "CAUTIOUS").alias("expected_gate"),
        F.when(k % 8 > 0, F.transform("lines", lambda x: text("reason_", p(x) % 20))).alias("reason_codes"), F.when(k % 9 == 0, F.array(F.lit("missing_report"))).alias("errors"),
        F.array(F.struct(F.lit("tracking").alias("artifact"), pick(3, "CURRENT", "OLD").alias("compatibility"))).alias("artifacts"), pick(6, "READY", "MISSING", "READY").alias("artifact_readiness"), F.when(k % 4 > 0, k % 2 == 0).alias("identity_reviewed"),
        some(2, mapping).alias("mappings"), some(3, interval).alias("tracking"), some(5, insight).alias("insights"), some(7, lambda x: F.struct(F.when(p(x) % 5 > 0, x["l_quantity"]).alias("start_s"))).alias("active_play"),
        F.filter(F.array(F.when(k % 10 == 0, "recording"), F.when(k % 15 == 0, "insight")), lambda x: x.isNotNull()).alias("incomplete"),
    )


def disagreements(spark, sf_dir):
    return E.disagreements(_samples(spark, sf_dir)).withColumn("evidence", F.array_join("evidence", ","))


def failure_reasons(spark, sf_dir):
    return E.failure_reasons(_samples(spark, sf_dir))


def policy_errors(spark, sf_dir):
    return E.policy_errors(_samples(spark, sf_dir))


def disagreement_summary(spark, sf_dir):
    return E.summary(_samples(spark, sf_dir)).withColumn("first_ids", F.array_join("first_ids", ","))


_NO = lambda n: f"CASE l_partkey % {n} WHEN 0 THEN 'NO' WHEN 1 THEN 'NOT_REVIEWED' ELSE 'YES' END"
_SAMPLES = """
o AS (SELECT o_orderkey AS k, 's' || o_orderkey AS sample_id, o_orderstatus AS status, ['STRONG', 'USABLE', 'LIMITED'][o_orderkey % 5 % 3 + 1] AS sq, ['STRONG', 'USABLE'][o_orderkey % 7 % 2 + 1] AS eq, o_orderkey % 5 - 2 AS delta,
    CASE WHEN o_orderkey % 3 > 0 THEN ['NORMAL', 'CAUTIOUS', 'INSUFFICIENT_EVIDENCE'][o_orderkey % 11 % 3 + 1] END AS sg, ['NORMAL', 'INSUFFICIENT_EVIDENCE', 'CAUTIOUS'][o_orderkey % 13 % 3 + 1] AS eg,
    'tracking:' || ['CURRENT', 'OLD'][o_orderkey % 3 % 2 + 1] AS evidence FROM orders),
l AS (SELECT o.*, lineitem.* FROM o JOIN lineitem ON l_orderkey = k)"""
_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT sample_id, '{kind}', 'i' || l_partkey || ':{field}', 'YES', 'Reviewer marked {field} incorrect.', CASE WHEN l_partkey % 2 = 0 THEN 'NORMAL' ELSE 'CAUTIOUS' END, evidence FROM l WHERE k % 5 = 0 AND {_NO(17 + 2 * i)} = 'NO'"
    for i, (field, kind) in enumerate(E.INSIGHT_FIELDS.items())
)
_FOUND = f"""{_SAMPLES},
d AS (
  SELECT sample_id, 'RECORDING_ASSESSMENT' AS category, sq AS output, eq AS expectation, 'Court4 recording quality differs from the reviewed verdict.' AS reason, 'RecordingQualityThresholds' AS rule, evidence FROM o WHERE sq <> eq
  UNION ALL SELECT sample_id, 'INSIGHT_GATING', sg, eg, 'Court4 evidence gate differs from the reviewed gate.', 'Match IQ quality gate', evidence FROM o WHERE sg <> eg
  UNION ALL SELECT sample_id, 'CANDIDATE_ASSOCIATION', 'c' || l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'SPECTATOR' ELSE 'COURT_PLAYER' END || ':' || CASE WHEN l_partkey % 3 > 0 THEN 'p' || l_suppkey ELSE 'no-player' END,
    'Reviewer marked the candidate-to-player mapping incorrect.', 'candidate association', evidence FROM l WHERE k % 2 = 0 AND {_NO(9)} = 'NO'
  UNION ALL SELECT sample_id, 'TRACKING_CONTINUITY', CASE WHEN l_partkey % 4 > 0 THEN 'c' || l_partkey ELSE 'no candidate' END, 'p' || l_suppkey || ' from ' || regexp_replace(printf('%.4f', l_partkey % 40 / 4), '\\.?0+$', '') || '-'
      || regexp_replace(printf('%.4f', l_partkey % 40 / 4 + l_quantity), '\\.?0+$', '') || 's', 'Reviewed interval contains an identity error or broken continuity.', 'tracking continuity', evidence FROM l WHERE k % 3 = 0 AND ({_NO(11)} = 'NO' OR l_partkey % 13 = 0)
  UNION ALL {_FIELD_ROWS}
  UNION ALL SELECT sample_id, 'INCOMPLETE_ANNOTATION', status, 'Complete independent review', 'Unreviewed fields: ' || CASE WHEN k % 10 = 0 AND k % 15 = 0 THEN 'recording, insight' WHEN k % 10 = 0 THEN 'recording' ELSE 'insight' END, NULL, evidence FROM o WHERE k % 10 = 0 OR k % 15 = 0)"""

DISAGREEMENTS_SQL = f"WITH {_FOUND} SELECT * FROM d"
FAILURES_SQL = f"""
WITH {_SAMPLES}, r AS (SELECT 'reason_' || l_partkey % 20 AS reason FROM l WHERE k % 8 > 0 UNION ALL SELECT 'missing_report' FROM o WHERE k % 9 = 0)
SELECT reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, reason) AS place FROM r GROUP BY 1
"""
POLICY_SQL = f"""
WITH {_SAMPLES}, r AS (SELECT k, 'reason_' || l_partkey % 20 AS reason FROM l WHERE k % 8 > 0 UNION ALL SELECT k, 'missing_assessment' FROM o WHERE k % 8 = 0),
e AS (SELECT k, 'quality_overestimation' AS kind FROM o WHERE delta > 0 UNION ALL SELECT k, 'quality_underestimation' FROM o WHERE delta < 0
  UNION ALL SELECT k, 'false_acceptance' FROM o WHERE eg = 'INSUFFICIENT_EVIDENCE' AND sg <> 'INSUFFICIENT_EVIDENCE' UNION ALL SELECT k, 'false_suppression' FROM o WHERE eg IN ('NORMAL', 'CAUTIOUS') AND sg = 'INSUFFICIENT_EVIDENCE')
SELECT kind, reason, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, reason) AS place FROM e JOIN r USING (k) GROUP BY 1, 2
"""
SUMMARY_SQL = f"""
WITH {_FOUND}, h AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), c AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(E.CATEGORIES))}) AS v(number, category)),
g AS (
  SELECT DISTINCT lower(category) AS category, sample_id FROM d WHERE category <> 'TRACKING_CONTINUITY'
  UNION SELECT 'artifact_compatibility', sample_id FROM o WHERE k % 6 % 3 = 1 UNION SELECT 'player_identity', sample_id FROM o WHERE k % 4 = 0
  UNION SELECT 'tracking_continuity', sample_id FROM o WHERE k % 3 > 0 OR k NOT IN (SELECT k FROM h) UNION SELECT 'active_play_state', sample_id FROM o WHERE k % 7 > 0 OR k NOT IN (SELECT k FROM h)
  UNION SELECT 'active_play_boundary', sample_id FROM l WHERE k % 7 = 0 AND l_partkey % 5 = 0),
n AS (SELECT category, count(*) AS n, array_to_string(list(sample_id ORDER BY sample_id)[1:10], ',') AS ids FROM g GROUP BY 1)
SELECT number, category, CASE WHEN category <> 'confidence' THEN coalesce(n, 0) END AS n, coalesce(ids, '') AS first_ids, CASE WHEN category <> 'confidence' THEN 'AVAILABLE' ELSE 'NOT_REVIEWED' END AS availability FROM c LEFT JOIN n USING (category)
"""

# ---- outcomes and counts ----

_OUTCOME_FIELDS = """
CASE WHEN o_orderkey % 8 > 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'UNSUITABLE' WHEN 1 THEN 'LIMITED' WHEN 2 THEN 'GOOD' WHEN 3 THEN 'EXCELLENT' ELSE 'ODD' END END AS system_quality,
CASE o_orderkey % 7 WHEN 0 THEN 'NOT_REVIEWED' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'GOOD' WHEN 3 THEN 'LIMITED' WHEN 4 THEN 'EXCELLENT' END AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN 'GOOD' ELSE 'UNSUITABLE' END AS label,
CASE WHEN o_orderkey % 4 > 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'CAUTIOUS' ELSE 'MEASUREMENT_ONLY' END END AS system_gate,
CASE o_orderkey % 11 WHEN 0 THEN 'NOT_REVIEWED' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'CAUTIOUS' WHEN 3 THEN 'MEASUREMENT_ONLY' ELSE 'NORMAL' END AS expected_gate"""


def sample_outcomes(spark, sf_dir):
    """How the system's verdicts on each sample stand to the reviewed ones."""
    k = F.col("o_orderkey")
    code = lambda n, name: F.filter(F.array(F.when(k % n == 0, name)), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[e.strip() for e in _fields(_OUTCOME_FIELDS)]).withColumns({"warnings": code(6, "thin"), "errors": code(10, "lost")})
    return E.outcomes(rows).select("o_orderkey", "expected_quality", "quality_delta", "exact", "acceptable", "gate_agrees", "outcome")


def _fields(text: str) -> list[str]:
    """Expressions that end in `AS name`."""
    out, at = [], 0
    for part in text.split(" AS ")[1:]:
        end = text.index(" AS ", at) + 4 + len(part.split(",")[0].rstrip())
        out.append(text[at:end])
        at = end + 1
    return out


def review_counts(spark, sf_dir):
    """Per customer: duplicates that reviewers counted, spectators counted or mapped, the share of active time, and their texts."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_partkey") % 2 == 0, "SPECTATOR").otherwise("COURT_PLAYER").alias("role"))).alias("mappings"), F.sum("l_quantity").alias("seconds"))
    rows = table(spark, sf_dir, "orders").join(lines, k == F.col("l_orderkey"), "left").withColumn("mappings", F.when(k % 2 == 0, F.col("mappings")))
    explicit, seconds = F.when(k % 3 == 0, k % 4), F.coalesce("seconds", F.lit(0.0))
    out = rows.groupBy("o_custkey").agg(
        E.optional_count(F.when(k % 5 == 0, k % 7)).alias("duplicates"), F.sum(E.count_or_role(explicit, "mappings", "SPECTATOR")).alias("spectators"), F.coalesce(F.sum(F.when(k % 2 == 0, seconds)), F.lit(0.0)).alias("active"),
        F.sum(F.when(k % 7 > 0, seconds).otherwise(0.0)).alias("whole"), F.count(F.lit(1)).alias("n"),
    )
    rate, raw = E.duration_rate(F.col("active"), F.col("whole"), F.col("n"), F.col("n") < 5), E.raw_metric(F.coalesce("spectators", F.lit(0)), F.col("n"), 8)
    return out.select("o_custkey", "duplicates", "spectators", (F.round(rate["percent"] * 1e6) / 1e6).alias("percent"), rate["text"].alias("text"), raw["provisional"].alias("provisional"), raw["note"].alias("note"))


OUTCOMES_SQL = f"""
WITH r AS (SELECT o_orderkey, {_OUTCOME_FIELDS} FROM orders), e AS (SELECT *, CASE WHEN verdict IN ('UNSUITABLE', 'LIMITED', 'GOOD', 'EXCELLENT') THEN verdict ELSE label END AS expected_quality FROM r),
d AS (SELECT *, nullif(list_position(['UNSUITABLE', 'LIMITED', 'GOOD', 'EXCELLENT'], system_quality), 0) - nullif(list_position(['UNSUITABLE', 'LIMITED', 'GOOD', 'EXCELLENT'], expected_quality), 0) AS quality_delta FROM e)
SELECT o_orderkey, expected_quality, quality_delta, quality_delta = 0 AS exact, abs(quality_delta) <= 1 AS acceptable, CASE WHEN expected_gate <> 'NOT_REVIEWED' THEN system_gate = expected_gate END AS gate_agrees,
  CASE WHEN system_quality IS NULL AND system_gate IS NULL THEN 'FAILED' WHEN o_orderkey % 6 > 0 AND o_orderkey % 10 > 0 THEN 'EVALUATED' ELSE 'PARTIAL' END AS outcome FROM d
"""
COUNTS_SQL = """
WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_partkey % 2 = 0) AS s, sum(l_quantity) AS seconds FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, o_orderkey AS k, n, s, coalesce(seconds, 0) AS seconds FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey, sum(CASE WHEN k % 5 = 0 THEN k % 7 END)::BIGINT AS duplicates, sum(CASE WHEN k % 3 = 0 THEN k % 4 WHEN k % 2 = 0 AND n > 0 THEN s END)::BIGINT AS spectators, coalesce(sum(seconds) FILTER (k % 2 = 0), 0) AS active,
    coalesce(sum(seconds) FILTER (k % 7 > 0), 0) AS whole, count(*) AS n FROM o GROUP BY 1)
SELECT o_custkey, duplicates, spectators, CASE WHEN whole > 0 THEN round(active / whole * 100, 6) END AS percent,
  printf('%.3f/%.3fs (', active, whole) || CASE WHEN whole > 0 THEN printf('%.1f%%', round(active / whole * 100, 1)) ELSE 'not available' END || '; ' || n || ' intervals)' || CASE WHEN n < 5 THEN ' — provisional' ELSE '' END AS text,
  n < 8 AS provisional, 'Raw total across ' || n || ' labeled samples; a percentage is not meaningful.' || CASE WHEN n < 8 THEN ' Coverage is provisional below 8 reviewed samples.' ELSE '' END AS note FROM g
"""

# ---- configurations ----

SCALARS, SECTIONS = ["frames", "extra"], {"detector": ["model", "threshold", "deep"]}


def stage_configurations(spark, sf_dir):
    """Defaults and overrides of every order's configuration as one canonical text, its fingerprint, and the keys that are not allowed."""
    base = """concat('{"labels":["z","a",{"b":1,"a":null}],"detector":{"model":"m', o_orderkey % 5, '","threshold":', o_orderkey % 7, '.5,"api_token":"x"},"Private-Key":1,"frames":', o_orderkey % 100, '}')"""
    change = """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('{"detector":{"threshold":', o_orderkey % 3, ',"deep":{"z":true,"é":"ß"}},"password":"p"}')
      WHEN 2 THEN '{"detector":7,"extra":[]}' ELSE '{"frames":{"a":1},"unknown":{"Cookie":2,"k":-1e3},"detector":{"size":2}}' END"""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{base} AS base", f"{change} AS change")
    text = D.canonical(F.col("base"), F.col("change"))
    return rows.select("o_orderkey", text.alias("text"), D.fingerprint(text).alias("fingerprint"), F.array_join(D.unknown_keys(F.col("change"), SCALARS, SECTIONS), ",").alias("unknown"))


CONFIGURATION_SQL = r"""
WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS m, '"labels":["z","a",{"a":null,"b":1}]' AS la, '"model":"m' || o_orderkey % 5 || '"' AS mo, o_orderkey % 100 AS fr FROM orders),
u AS (SELECT *, CASE m
    WHEN 0 THEN '{"detector":{' || mo || ',"threshold":' || o_orderkey % 7 || '.5},"frames":' || fr || ',' || la || '}'
    WHEN 1 THEN '{"detector":{"deep":{"z":true,"\u00e9":"\u00df"},' || mo || ',"threshold":' || o_orderkey % 3 || '},"frames":' || fr || ',' || la || '}'
    WHEN 2 THEN '{"detector":7,"extra":[],"frames":' || fr || ',' || la || '}'
    ELSE '{"detector":{' || mo || ',"size":2,"threshold":' || o_orderkey % 7 || '.5},"frames":{"a":1},' || la || ',"unknown":{"k":-1000.0}}' END AS text FROM t)
SELECT o_orderkey, text, sha256(text) AS fingerprint, ['', 'password', 'detector', 'detector.size,unknown'][m + 1] AS unknown FROM u
"""

QUERIES = {f.__name__: f for f in (disagreements, failure_reasons, policy_errors, disagreement_summary, sample_outcomes, review_counts, stage_configurations)}
ORACLES = dict(zip(QUERIES, (DISAGREEMENTS_SQL, FAILURES_SQL, POLICY_SQL, SUMMARY_SQL, OUTCOMES_SQL, COUNTS_SQL, CONFIGURATION_SQL)))
