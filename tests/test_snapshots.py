"""A snapshot merged delivery by delivery against versions made from the whole log."""

import os
import random

import pytest

from strideframe.operators import snapshots as S

KEYS, CONTENT = ["k"], ["c", "n"]
CHANGES = "k long, seq long, c string, n long"


def plain(log):
    out, held = [], {}
    for k, seq, c, n in sorted(set(log)):
        if k in held and held[k][-1][2:] == (c, n):
            continue
        held.setdefault(k, []).append((len(held.get(k, [])) + 1, seq, c, n))
    for k, rows in held.items():
        out += [(k, *r, r is rows[-1]) for r in rows]
    return sorted(out)


def deliveries(seed):
    rng = random.Random(seed)
    log = [(rng.randrange(9), seq, rng.choice(["a", "b", None]), rng.randrange(2)) for seq in range(120)]
    return log, [log[:50] + log[:5], log[40:90], log[90:], log[60:], log]


@pytest.mark.parametrize("seed", [1, 2])
def test_deliveries_in_steps_equal_the_whole_log(spark, seed):
    log, steps = deliveries(seed)
    held = None
    for step in steps:
        changes = spark.createDataFrame(step, CHANGES)
        held = S.merged(held if held is not None else S.empty(changes, KEYS, CONTENT), changes, KEYS, CONTENT)
        held = spark.createDataFrame(held.collect(), held.schema)
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in held.collect()), key=key) == sorted(plain(log), key=key)
    again = S.outcomes(held, spark.createDataFrame(log, CHANGES), KEYS, CONTENT)
    assert {r.outcome for r in again.collect()} <= {"BEFORE", "PRESENT"}


def test_a_stored_snapshot_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    log, steps = deliveries(3)
    for step in steps:
        S.merge_into(spark, path, spark.createDataFrame(step, CHANGES), KEYS, CONTENT, 4)
    key = lambda r: tuple(map(repr, r))

    def stored():
        return sorted((tuple(r) for r in spark.read.parquet(path).select("k", "version", "seq", "c", "n", "is_current").collect()), key=key)

    assert stored() == sorted(plain(log), key=key)
    files = {f for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    more = [(3, 500, "z", 9)]
    S.merge_into(spark, path, spark.createDataFrame(more, CHANGES), KEYS, CONTENT, 4)
    assert stored() == sorted(plain(log + more), key=key)
    now = {f for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    assert {os.path.dirname(f) for f in files ^ now} == {os.path.dirname(next(iter(now - files)))} and files & now


def test_a_task_gets_a_bounded_share_of_the_changes(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 20)
    log, steps = deliveries(4)
    changes = spark.createDataFrame(log, CHANGES)
    tasks = S.tasks_for(len(log))
    assert tasks == 6 and S.tasks_for(0) == 1
    rows = S.outcomes(S.empty(changes, KEYS, CONTENT), changes, KEYS, CONTENT, tasks=tasks)
    assert rows.rdd.getNumPartitions() == 6  # the session has 4
    key = lambda r: tuple(map(repr, r))
    first = S.merged(S.empty(changes, KEYS, CONTENT), spark.createDataFrame(steps[0], CHANGES), KEYS, CONTENT, tasks=3)
    got = S.merged(spark.createDataFrame(first.collect(), first.schema), changes, KEYS, CONTENT, tasks=tasks)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(log), key=key)
