"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition makes one sorted run of (key, rows, kept id) for each lane, where a lane is a fixed slice of the digest space. Runs are rows of packed blocks
of BLOCK entries. In each round the runs numbered k*fan_in .. k*fan_in+fan_in-1 of a lane meet in one task, which merges them two by two (a binomial tree) without
sorting anew; equal keys become one entry again, with the rows' sum and the best id. After ceil(log_fan_in(partitions)) rounds each lane has one run. A
group of copies, however large, is one entry of each run from the start; the number of lanes grows with the rows (LANE_ROWS), so that a run fits a task.

An entry is verified at every level: texts count as equal only by digest, byte length and a second, independent 64-bit hash together, which are the key.

Nulls: a null text counts as empty. Rows that repeat are separate rows of a group, and as all share an id they are all kept where it is the best; a null id is kept
only where all of the group's ids are null. Texts of any length are one row; keys never tie. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, with_group

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per document: `key`, the digest, length and check hash of its text with A-Z lowered."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    key = F.concat(F.unhex(F.sha2("t", 256)), number(F.octet_length("t").cast("long")), number(F.xxhash64("t")))
    return docs.select("doc_id", text.alias("t")).select("doc_id", key.alias("key"))


RUN = "lane int, run int, block int, keys binary, ids binary, known binary, counts binary"
BLOCK = 50_000
LANE_ROWS = 2_000_000
KEY_BYTES = 48


def _better(ids, known, other, other_known, keep: str):
    """The ids that stay of two columns, and whether there is one."""
    pick = np.minimum if keep == "smallest" else np.maximum
    return np.where(known & other_known, pick(ids, other), np.where(known, ids, other)), known | other_known


def merged(a: tuple, b: tuple, keep: str) -> tuple:
    """Two sorted runs (keys, ids, known, counts) as one; a key of both becomes one entry."""
    at = np.searchsorted(a[0], b[0])
    twin = np.zeros(len(at), bool)
    inside = at < len(a[0])
    twin[inside] = a[0][at[inside]] == b[0][inside]
    ids, known, counts = (x.copy() for x in a[1:])
    where = at[twin]
    ids[where], known[where] = _better(ids[where], known[where], b[1][twin], b[2][twin], keep)
    counts[where] += b[3][twin]
    new = ~twin
    return tuple(np.insert(x, at[new], y[new]) for x, y in zip((a[0], ids, known, counts), b))


def run_of(keys: np.ndarray, ids: np.ndarray, known: np.ndarray, keep: str) -> tuple:
    """The sorted run of single rows."""
    order = np.lexsort((ids if keep == "smallest" else -ids, ~known, keys))
    keys, ids, known = keys[order], ids[order], known[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], ids[first], known[first], np.diff(np.append(first, len(keys)))


def _packed(lane: int, run: int, held: tuple) -> pd.DataFrame:
    keys, ids, known, counts = held
    rows = []
    for k, lo in enumerate(range(0, len(keys), BLOCK)):
        part = slice(lo, lo + BLOCK)
        rows.append((lane, run, k, keys[part].tobytes(), ids[part].astype("<i8").tobytes(), known[part].tobytes(), counts[part].astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=["lane", "run", "block", "keys", "ids", "known", "counts"])


def _unpacked(pdf: pd.DataFrame) -> tuple:
    """The entries of a run's blocks, in order."""
    kinds = {"keys": f"S{KEY_BYTES}", "ids": "<i8", "known": bool, "counts": "<i8"}
    return tuple(np.concatenate([np.frombuffer(x, kind) for x in pdf[name]]) for name, kind in kinds.items())


def sorted_runs(rows: DataFrame, keep: str, lanes: int) -> DataFrame:
    """Each partition's runs, one of each lane, of digest_rows()."""

    def run(batches):
        # a lane's runs, each at least twice as long as the one behind it
        held: dict[int, list[tuple]] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            keys = np.array([x.ljust(KEY_BYTES, b"\0") for x in pdf["key"]], f"S{KEY_BYTES}")
            ids, known = pdf["id"].to_numpy(np.int64), pdf["known"].to_numpy(bool)
            lane = keys.view(np.uint8).reshape(-1, KEY_BYTES)[:, :4].copy().view(">u4").ravel().astype(np.int64) * lanes >> 32
            for k in np.unique(lane):
                own = held.setdefault(k, [])
                own.append(run_of(keys[lane == k], ids[lane == k], known[lane == k], keep))
                while len(own) > 1 and len(own[-2][0]) < 2 * len(own[-1][0]):
                    own[-2:] = [merged(own[-2], own[-1], keep)]
        number = TaskContext.get().partitionId()  # of the task that makes the runs, so each lane has one run of a number
        for k, own in held.items():
            while len(own) > 1:
                own[-2:] = [merged(own[-2], own[-1], keep)]
            yield _packed(int(k), number, own[0])

    # pandas would turn ids beside a null into floating-point numbers
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "key").mapInPandas(run, RUN)


def tree_merge(rows: DataFrame, keep: str = "smallest", fan_in: int = 8, lanes: int | None = None) -> DataFrame:
    """One row per distinct text of digest_rows(): key, keep_id and group_size."""
    n = rows.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = lanes or max(2 * tasks, -(-n // LANE_ROWS))
    runs = saved(sorted_runs(rows, keep, lanes), "runs")
    run_count = (runs.agg(F.max("run")).first()[0] or 0) + 1

    def merge(key, pdf):
        runs = [_unpacked(own.sort_values("block")) for _, own in pdf.groupby("run")]
        while len(runs) > 1:
            runs = [merged(*runs[k : k + 2], keep) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return _packed(int(key[0]), int(key[1]), runs[0])

    while run_count > 1:
        run_count = -(-run_count // fan_in)
        runs = runs.groupBy("lane", F.floor(F.col("run") / fan_in).cast("int").alias("into")).applyInPandas(merge, RUN)

    def entries(batches):
        for pdf in batches:
            for k in range(len(pdf)):
                keys, ids, known, counts = _unpacked(pdf.iloc[k : k + 1])
                raw = keys.tobytes()
                out = pd.DataFrame({"key": [raw[i : i + KEY_BYTES] for i in range(0, len(raw), KEY_BYTES)], "keep_id": pd.Series(ids).astype("Int64").where(known)})
                yield out.assign(group_size=counts)

    return runs.mapInPandas(entries, "key binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Every row of `docs` with the id that stays of its group, the group's size and whether it is the one that stays."""
    rows = saved(digest_rows(docs), "digests")
    groups = saved(tree_merge(rows, keep), "digest-groups")
    digest = F.lower(F.hex(F.substring("key", 1, 32)))
    return with_group(rows, groups, ["key"], "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), digest.alias("text_sha256")
    )


def op3_tree_merge(docs: DataFrame) -> DataFrame:
    return exact_groups(docs, keep="largest")
