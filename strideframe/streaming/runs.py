"""The state changes of runs and stages as a stream: one keyed state per subject, timers for leases, refused commands apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import COMMAND, OUTCOME, Subject, expired, frame, step

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_commands(spark: SparkSession, path: str, late: str, files: int | None = None) -> DataFrame:
    """Commands that arrive as JSON files in `path`, `files` of them at a time at most; `at` is their event time. `late` is more than nothing, as a row at the watermark counts as late."""
    reader = spark.readStream.schema(COMMAND)
    df = (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)
    return df.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)


class _Runs(StatefulProcessor):
    def __init__(self, lease_us: int):
        self.lease_us = lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("subject", "state string, version long, deadline long")

    def _subject(self) -> Subject:
        return Subject(*self.held.get()) if self.held.exists() else Subject()

    def _keep(self, held: Subject) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held.deadline is not None:
            self.handle.registerTimer(held.deadline // 1000 + 1)
        self.held.update(tuple(held))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._subject(), []
        for c in pd.concat(list(rows)).sort_values(["at_us", "seq"]).itertuples():
            expected = None if pd.isna(c.expected_version) else int(c.expected_version)
            held, more = step(int(c.subject), held, c.kind, int(c.seq), int(c.at_us), expected, c.new_state, c.category, self.lease_us)
            out += more
        self._keep(held)
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._subject()
        if held.deadline is None:
            return
        held, row = expired(int(key[0]), held)
        self._keep(held)
        yield frame([row])

    def close(self) -> None:
        pass


def outcomes(commands: DataFrame, lease_us: int) -> DataFrame:
    """OUTCOME rows as they come about. The session's state store must be STORE.

    Commands of a subject are taken in the order of (at_us, seq) within a batch, so batches cut anywhere give what the batch audit gives as long as they come in
    that order; a lease runs out at the next command after it or once the watermark has passed it.
    """
    return commands.groupBy("subject").transformWithStateInPandas(_Runs(lease_us), OUTCOME, "Append", "EventTime")


def write_outcomes(rows: DataFrame, path: str, checkpoint: str):
    """Two tables: `path`/applied with the changes, `path`/refused with the commands that changed nothing. A batch that is repeated replaces its own files."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        applied = F.col("outcome").isin("APPLIED", "LEASE_EXPIRED")
        for name, part in (("applied", batch.where(applied)), ("refused", batch.where(~applied))):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return rows.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).start()
