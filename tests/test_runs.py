"""State changes as a batch and as a stream, cut into batches in several ways."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators.runs import COMMAND, audit, current_artifacts
from strideframe.streaming import runs as S

LEASE = 50_000_000
STATES = ["processing", "processing", "completed", "failed", "cancelled", "stale", "unavailable"]


def commands(n, subjects, seed):
    rng, at, rows = random.Random(seed), 0, []
    for seq in range(n):
        at += rng.choice([0, 1_000_000, 3_000_000])
        subject = rng.randrange(subjects)
        rows.append((subject, "run" if subject % 2 else "stage", seq, at, rng.choice([1, 2, 2, 3]), rng.choice(STATES), rng.choice([None, " ", "broken"])))
    return rows


def test_a_run_is_swapped_only_at_its_version_and_loses_its_lease(spark):
    rows = [
        (1, "run", 0, 0, 1, "completed", None), (1, "run", 1, 1, 7, "processing", None), (1, "run", 2, 2, 1, "processing", None), (1, "run", 3, 3, 9, "processing", None),
        (1, "run", 4, LEASE + 2, 2, "failed", None), (1, "run", 5, LEASE + 3, 3, "completed", None),
        (2, "stage", 0, 0, 1, "processing", None), (2, "stage", 1, LEASE + 1, 2, "completed", None), (3, "stage", 0, 0, 1, "failed", " "), (3, "stage", 1, 1, 1, "unavailable", None), (4, "run", 0, 5, 1, "processing", None),
    ]
    got = audit(spark.createDataFrame(rows, COMMAND), LEASE, until_us=10 * LEASE).orderBy("subject", "at_us", F.col("seq").asc_nulls_first()).collect()
    assert [(r.subject, r.seq, r.outcome, r.row_version) for r in got] == [
        (1, 0, "INVALID_TRANSITION", 1), (1, 1, "CONFLICT", 1), (1, 2, "APPLIED", 2), (1, 3, "UNCHANGED", 2), (1, 4, "APPLIED", 3), (1, 5, "INVALID_TRANSITION", 3),
        (2, 0, "APPLIED", 2), (2, None, "LEASE_EXPIRED", 3), (2, 1, "INVALID_TRANSITION", 3), (3, 0, "MISSING_CATEGORY", 1), (3, 1, "APPLIED", 2), (4, 0, "APPLIED", 2), (4, None, "LEASE_EXPIRED", 3),
    ]


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_the_stream_gives_the_batch_audit_in_any_batching(spark, tmp_path, cuts):
    rows = commands(120, 12, 5)
    end = rows[-1][3] + 100 * LEASE
    batches = [rows[len(rows) * k // cuts : len(rows) * (k + 1) // cuts] for k in range(cuts)] + [[(99, "run", 0, end, 1, "cancelled", None)]]
    names = [c.split()[0] for c in COMMAND.split(", ")]
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    try:
        stream = S.outcomes(S.read_commands(spark, str(tmp_path / "in"), "1 second"), LEASE)
        query = S.write_outcomes(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        for k, batch in enumerate(batches):
            (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in batch))
            (tmp_path / f"{k}.json").rename(tmp_path / "in" / f"{k}.json")
            query.processAllAvailable()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = sorted(map(tuple, audit(spark.createDataFrame(rows + batches[-1], COMMAND), LEASE, until_us=end).collect()), key=repr)
    applied, refused = (spark.read.parquet(str(tmp_path / "out" / n)).drop("batch") for n in ("applied", "refused"))
    assert sorted(map(tuple, applied.unionByName(refused).collect()), key=repr) == want
    assert {r[0] for r in refused.select("outcome").distinct().collect()} == {"UNCHANGED", "INVALID_TRANSITION", "CONFLICT", "MISSING_CATEGORY"}


def test_artifacts_stay_current_until_another_execution_completes(spark):
    made = [(1, "a", 10, 5), (1, "a", 10, 25), (1, "a", 11, 8), (1, "a", 12, 30), (2, "a", 13, 1), (1, "b", 14, 0)]
    done = [(1, "a", 10, 20), (1, "a", 11, 15), (1, "b", 14, 9), (1, "a", 10, 12)]
    rows = current_artifacts(spark.createDataFrame(made, "analysis long, stage string, execution long, made_us long"), spark.createDataFrame(done, "analysis long, stage string, execution long, done_us long"), ["analysis", "stage"]).collect()
    got = {(r.execution, r.made_us): r.is_current for r in rows}
    assert got == {(e, m): not any(a == x and s == y and e != f and d > m for x, y, f, d in done) for a, s, e, m in made}
