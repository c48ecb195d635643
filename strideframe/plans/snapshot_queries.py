"""Queries over an incremental snapshot, each with the DuckDB statement that checks it: orders register the state of their customer's priority class, in three overlapping deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as S
from ..session import table, written

KEYS, CONTENT = ["o_custkey", "o_orderpriority"], ["status", "size"]


def _registrations(spark, sf_dir):
    """All registrations dealt by customer, and over how many tasks."""
    price = F.floor(F.col("o_totalprice") / 250000).cast("long")
    orders = table(spark, sf_dir, "orders")
    tasks = S.tasks_for(orders.count())
    return orders.select(*KEYS, F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), price.alias("size")).repartition(tasks, "o_custkey"), tasks


def _thirds(rows):
    """Three deliveries by order number within a customer: the second repeats the first one's later half, the third all of the second."""
    most = rows.groupBy("o_custkey").agg(F.max("seq").alias("most"))
    rows = rows.join(most, "o_custkey")
    upto = lambda part: F.col("seq") * 4 <= F.col("most") * part
    cuts = (upto(2), ~upto(1) & upto(3), ~upto(1))
    return [rows.where(c).drop("most") for c in cuts]


def _history(rows, tasks):
    first, second, _ = _thirds(rows)
    held = S.merged(S.empty(rows, KEYS, CONTENT), first, KEYS, CONTENT, tasks=tasks)
    return written(S.merged(written(held, "first"), second, KEYS, CONTENT, tasks=tasks), "second")


def snapshot_merge(spark, sf_dir):
    """The snapshot after three deliveries, the last one twice."""
    rows, tasks = _registrations(spark, sf_dir)
    last = _thirds(rows)[2]
    held = written(S.merged(_history(rows, tasks), last, KEYS, CONTENT, tasks=tasks), "third")
    return S.merged(held, last, KEYS, CONTENT, tasks=tasks)


def change_outcomes(spark, sf_dir):
    """What each registration of the last delivery means for the snapshot before it."""
    rows, tasks = _registrations(spark, sf_dir)
    return S.outcomes(_history(rows, tasks), _thirds(rows)[2], KEYS, CONTENT, tasks=tasks).select(*KEYS, "seq", "outcome", "version")


_VERSIONS = """
r AS (SELECT o_custkey, o_orderpriority, o_orderkey AS seq, o_orderstatus AS status, CAST(floor(o_totalprice / 250000) AS BIGINT) AS size, max(o_orderkey) OVER (PARTITION BY o_custkey) AS most FROM orders),
f AS (SELECT *, lag(seq) OVER w IS NULL OR status IS DISTINCT FROM lag(status) OVER w OR size IS DISTINCT FROM lag(size) OVER w AS fresh FROM r WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY seq)),
v AS (SELECT *, CASE WHEN fresh THEN sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY seq ROWS UNBOUNDED PRECEDING) END::BIGINT AS version FROM f)"""
SNAPSHOT_SQL = f"""
WITH {_VERSIONS} SELECT o_custkey, o_orderpriority, version, seq, status, size, version = max(version) OVER (PARTITION BY o_custkey, o_orderpriority) AS is_current FROM v WHERE version IS NOT NULL
"""
OUTCOMES_SQL = f"""
WITH {_VERSIONS}, h AS (SELECT o_custkey, o_orderpriority, max(seq) AS head FROM v WHERE version IS NOT NULL AND seq * 4 <= most * 3 GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, seq, CASE WHEN seq <= head THEN 'BEFORE' WHEN version = 1 THEN 'IMPORTED' WHEN version IS NULL THEN 'PRESENT' ELSE 'VERSION' END AS outcome, CASE WHEN head IS NULL OR seq > head THEN version END AS version
FROM v LEFT JOIN h USING (o_custkey, o_orderpriority) WHERE seq * 4 > most
"""

QUERIES = {f.__name__: f for f in (snapshot_merge, change_outcomes)}
ORACLES = {"snapshot_merge": SNAPSHOT_SQL, "change_outcomes": OUTCOMES_SQL}
