"""State changes of runs and stages: compare-and-swap on the row version, leases, and what a completed stage makes of earlier artifacts.

Commands are rows of COMMAND in the order of (at_us, seq) within a subject. step() is all there is to a subject's state; the batch audit here and the stream in
`strideframe.streaming.runs` call it alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMAND = "subject long, kind string, seq long, at_us long, expected_version long, new_state string, category string"
OUTCOME = "subject long, seq long, at_us long, from_state string, to_state string, outcome string, row_version long"
_NAMES = [c.split()[0] for c in OUTCOME.split(", ")]
#: Which states follow which.
ALLOWED = {
    "run": {"queued": {"processing", "cancelled"}, "processing": {"completed", "failed", "cancelled", "stale"}},
    "stage": {"queued": {"processing", "cancelled", "unavailable"}, "processing": {"completed", "failed", "cancelled", "stale", "unavailable"}},
}


class Subject(NamedTuple):
    """A run or stage: its state and version, and until when it may be processing."""

    state: str = "queued"
    version: int = 1
    deadline: int | None = None


def expired(key: int, held: Subject) -> tuple[Subject, tuple]:
    """The subject after its lease has run out."""
    return Subject("stale", held.version + 1), (key, None, held.deadline, held.state, "stale", "LEASE_EXPIRED", held.version + 1)


def step(key: int, held: Subject, kind: str, seq: int, at_us: int, expected: int | None, new_state: str, category: str | None, lease_us: int) -> tuple[Subject, list[tuple]]:
    """The subject after a command, and the rows of OUTCOME: a lease that ran out before, and what became of the command."""
    rows = []
    if held.deadline is not None and at_us > held.deadline:
        held, row = expired(key, held)
        rows.append(row)
    state = held.state
    if kind == "stage" and new_state == "failed" and not (category or "").strip():
        outcome = "MISSING_CATEGORY"
    elif state == new_state:
        outcome = "UNCHANGED"
    elif new_state not in ALLOWED[kind].get(state, ()):
        outcome = "INVALID_TRANSITION"
    elif expected != held.version:
        outcome = "CONFLICT"
    else:
        outcome = "APPLIED"
        held = Subject(new_state, held.version + 1, at_us + lease_us if new_state == "processing" else None)
    rows.append((key, seq, at_us, state, new_state, outcome, held.version))
    return held, rows


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"seq": "Int64"})


def audit(commands: DataFrame, lease_us: int, until_us: int | None = None) -> DataFrame:
    """OUTCOME rows of all commands. Leases that run out before `until_us` count too where no command follows.

    A task reads its subjects as one sorted stream and holds the state of one at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, Subject()

        def left():
            return [expired(key, held)[1]] if key is not None and held.deadline is not None and until_us is not None and held.deadline < until_us else []

        for pdf in batches:
            rows = []
            for subject, kind, seq, at_us, expected, new_state, category in pdf.itertuples(index=False):
                if subject != key:
                    rows += left()
                    key, held = subject, Subject()
                held, more = step(subject, held, kind, seq, at_us, expected, new_state, category, lease_us)
                rows += more
            yield frame(rows)
        yield frame(left())

    columns = [c.split()[0] for c in COMMAND.split(", ")]
    return commands.select(columns).repartition("subject").sortWithinPartitions("subject", "at_us", "seq").mapInPandas(fold, OUTCOME)


def current_artifacts(artifacts: DataFrame, completions: DataFrame, group: list[str]) -> DataFrame:
    """`artifacts` (*group, execution, made_us, …) with `is_current`: no other execution of the group completed after it was made.

    `completions` (*group, execution, done_us). Of a group only the last completion and the last one of any other execution matter, so the history is
    aggregated to one row.
    """
    per = completions.groupBy(*group, "execution").agg(F.max("done_us").alias("done_us"))
    last = per.groupBy(*group).agg(F.max(F.struct("done_us", "execution")).alias("last"))
    others = per.join(last, group).where(F.col("execution") != F.col("last.execution")).groupBy(*group).agg(F.max("done_us").alias("second"))
    known = last.join(others, group, "left")
    rows = artifacts.join(known, group, "left")
    other = F.when(F.col("last.execution") == F.col("execution"), F.col("second")).otherwise(F.col("last.done_us"))
    return rows.withColumn("is_current", ~F.coalesce(other > F.col("made_us"), F.lit(False))).drop("last", "second")
