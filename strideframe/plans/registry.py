"""Every query of the engine by name, with the DuckDB statement that checks it."""

from __future__ import annotations

from . import activity_queries, artifact_queries, calibration_queries, check_queries, decision_queries, evaluation_queries, history_queries, merge_queries, movement_queries, record_queries, run_queries, snapshot_queries

MODULES = (movement_queries, activity_queries, record_queries, decision_queries, check_queries, artifact_queries, merge_queries, run_queries, calibration_queries, snapshot_queries, evaluation_queries, history_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
