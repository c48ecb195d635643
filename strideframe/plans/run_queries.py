"""Queries over state changes and artifacts of runs, each with the DuckDB statement that checks it. Orders are runs or stages, their line items are commands by shipping date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..session import table

LEASE_DAYS = 30
_DAY = 86_400_000_000
#: For both engines: commands from line items.
_COMMANDS = """
SELECT subject, kind, seq, at_us, CASE WHEN l_suppkey % 2 = 0 THEN least(seq, 2) ELSE 1 + l_partkey % 3 END AS expected_version,
  CASE WHEN seq = 1 AND l_suppkey % 4 < 3 THEN 'processing' ELSE CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed'
    WHEN 4 THEN 'cancelled' WHEN 5 THEN 'stale' ELSE 'unavailable' END END AS new_state,
  CASE WHEN l_quantity > 25 THEN 'detector error' WHEN l_quantity > 15 THEN ' ' END AS category
FROM (SELECT *, l_orderkey AS subject, CASE WHEN l_orderkey % 2 = 0 THEN 'run' ELSE 'stage' END AS kind,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq, {us} AS at_us FROM lineitem)"""


def _commands(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    us = "timestampdiff(MICROSECOND, timestamp_ntz'2000-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))"
    text = _COMMANDS.format(us=us).replace("FROM lineitem", "FROM {lines}")
    return spark.sql(text, lines=lines).selectExpr(*[f"CAST({n} AS {k}) AS {n}" for n, k in (c.split() for c in R.COMMAND.split(", "))])


def run_transitions(spark, sf_dir):
    """What became of every command, and leases of thirty days that ran out before the next one."""
    return R.audit(_commands(spark, sf_dir), LEASE_DAYS * _DAY)


def run_states(spark, sf_dir):
    """Commands and changes by kind of outcome."""
    rows = R.audit(_commands(spark, sf_dir), LEASE_DAYS * _DAY)
    return rows.groupBy("from_state", "to_state", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("row_version").alias("most"))


def current_artifacts(spark, sf_dir):
    """Line items as artifacts of the orders' executions: which are current after all completions of the customer's orders of that priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    done = R.audit(_commands(spark, sf_dir), LEASE_DAYS * _DAY).where("outcome = 'APPLIED' AND to_state = 'completed'").join(orders, F.col("subject") == F.col("o_orderkey"))
    done = done.select("o_custkey", "o_orderpriority", F.col("subject").alias("execution"), F.col("at_us").alias("done_us"))
    made = _commands(spark, sf_dir).join(orders, F.col("subject") == F.col("o_orderkey")).select("o_custkey", "o_orderpriority", F.col("subject").alias("execution"), "seq", F.col("at_us").alias("made_us"))
    return R.current_artifacts(made, done, ["o_custkey", "o_orderpriority"]).select("execution", "seq", "is_current")


def _pairs(kind: str) -> str:
    return ", ".join(f"'{a}>{b}'" for a, after in R.ALLOWED[kind].items() for b in sorted(after))


_RUNS = f"""
cm AS ({_COMMANDS.format(us="epoch_us(l_shipdate) - epoch_us(TIMESTAMP '2000-01-01')")}),
rs AS (
  SELECT DISTINCT subject, 0::BIGINT AS seq, NULL::BIGINT AS at_us, 'queued' AS state, 1::BIGINT AS version, NULL::BIGINT AS deadline, NULL::VARCHAR AS from_state, NULL::VARCHAR AS to_state, NULL::VARCHAR AS outcome, NULL::BIGINT AS ran_out, NULL::BIGINT AS out_version FROM cm
  UNION ALL
  SELECT subject, seq, at_us, CASE WHEN outcome = 'APPLIED' THEN new_state ELSE s END, CASE WHEN outcome = 'APPLIED' THEN v + 1 ELSE v END,
    CASE WHEN outcome = 'APPLIED' THEN CASE WHEN new_state = 'processing' THEN at_us + {LEASE_DAYS * _DAY} END ELSE d END, s, new_state, outcome, CASE WHEN late THEN deadline END, CASE WHEN late THEN v END
  FROM (SELECT *, CASE WHEN kind = 'stage' AND new_state = 'failed' AND trim(coalesce(category, '')) = '' THEN 'MISSING_CATEGORY' WHEN s = new_state THEN 'UNCHANGED'
      WHEN kind = 'run' AND s || '>' || new_state NOT IN ({_pairs("run")}) OR kind = 'stage' AND s || '>' || new_state NOT IN ({_pairs("stage")}) THEN 'INVALID_TRANSITION'
      WHEN expected_version <> v THEN 'CONFLICT' ELSE 'APPLIED' END AS outcome
    FROM (SELECT *, CASE WHEN late THEN 'stale' ELSE state END AS s, CASE WHEN late THEN version + 1 ELSE version END AS v, CASE WHEN NOT late THEN deadline END AS d
      FROM (SELECT c.*, r.state, r.version, r.deadline, coalesce(c.at_us > r.deadline, false) AS late FROM rs r JOIN cm c ON c.subject = r.subject AND c.seq = r.seq + 1)))),
oc AS (SELECT subject, seq, at_us, from_state, to_state, outcome, version AS row_version FROM rs WHERE seq > 0
  UNION ALL SELECT subject, NULL, ran_out, 'processing', 'stale', 'LEASE_EXPIRED', out_version FROM rs WHERE ran_out IS NOT NULL)"""

TRANSITIONS_SQL = f"WITH RECURSIVE {_RUNS} SELECT * FROM oc"
STATES_SQL = f"WITH RECURSIVE {_RUNS} SELECT from_state, to_state, outcome, count(*) AS n, max(row_version) AS most FROM oc GROUP BY 1, 2, 3"
ARTIFACTS_SQL = f"""
WITH RECURSIVE {_RUNS},
dn AS (SELECT o_custkey, o_orderpriority, subject, at_us FROM oc JOIN orders ON o_orderkey = subject WHERE outcome = 'APPLIED' AND to_state = 'completed')
SELECT cm.subject AS execution, cm.seq, NOT EXISTS (SELECT 1 FROM dn WHERE dn.o_custkey = o.o_custkey AND dn.o_orderpriority = o.o_orderpriority AND dn.subject <> cm.subject AND dn.at_us > cm.at_us) AS is_current
FROM cm JOIN orders o ON o.o_orderkey = cm.subject
"""

QUERIES = {f.__name__: f for f in (run_transitions, run_states, current_artifacts)}
ORACLES = {"run_transitions": TRANSITIONS_SQL, "run_states": STATES_SQL, "current_artifacts": ARTIFACTS_SQL}
