"""Shared helpers of the corpus operators: tables in the shared folder, and vectorised word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table  # noqa: F401  (queries take it from here)

_written: list = []
#: A join on (key, more) may keep sides that are dealt out by the key alone.
PLANNING = {"all_keys": "spark.sql.requireAllClusterKeysForCoPartition", "rows_per_file": "spark.sql.files.maxRecordsPerFile", "batch_rows": "spark.sql.execution.arrow.maxRecordsPerBatch"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session without other machines gets one of its own where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strideframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings while a table is written; the earlier ones come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str, compression: str = "snappy", **more: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors. `more`: settings of PLANNING that hold meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # `df` runs once: its shuffles need not outlive the write
    with settings(spark, {CLEANUP: "true", **{PLANNING[k]: v for k, v in more.items()}}):
        df.write.parquet(path, compression=compression)
    _written.append((spark, path))
    release(spark)  # a long run of small steps would otherwise grow the driver's heap up to its limit
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that saved() has returned and that nothing reads any more."""
    for df in tables:
        _written[:] = [x for x in _written if x[1] != df.saved_at]
        _delete(df.sparkSession, df.saved_at)


def release(spark: SparkSession) -> None:
    """Lets Spark free the broadcasts and shuffles of tables that are no longer referenced: it does so when the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


def mark() -> int:
    """Where discard() starts from."""
    return len(_written)


def discard(since: int, keep_last: bool = True) -> None:
    """Deletes what saved() has written since mark() gave `since`, but for the last table."""
    spent = _written[since : -1 if keep_last else None]
    del _written[since : len(_written) - keep_last]
    for spark, path in spent:
        _delete(spark, path)
    if spent:
        release(spent[0][0])


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  a session that has ended can delete nothing; others may
        pass


def _remove() -> None:
    for spark, path in _written:
        _delete(spark, path)


HOT_PART = 1_000


def with_group(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """`rows`, `total` of them, joined to their row of `groups` (unique `key`, `size` rows each), however large a group is.

    Groups of more than a HOT_PART-th of the rows are fewer than HOT_PART, so they are broadcast and their rows stay where they are.
    """
    hot = F.col(size) * HOT_PART > total
    marked = rows.join(F.broadcast(groups.where(hot)), key, "left")
    rest = marked.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(~hot).hint("merge"), key)
    return marked.where(F.col(size).isNotNull()).unionByName(rest)


atexit.register(_remove)


def row_id():
    """A row's identity by doc_id and text, in 128 bits."""
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def id_hash(column: str = "doc_id"):
    """crc32 of the id written as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


# ---- words of whole UTF-8 texts, hashed in numpy without a loop over words ----

_MASK = (1 << 64) - 1
_RADIX = 0x9E3779B97F4A7C15
_byte_values: dict = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bytes_of(seed: int) -> np.ndarray:
    if seed not in _byte_values:
        _byte_values[seed] = np.random.default_rng(20240101 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _byte_values[seed]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, radix in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
        while len(_powers[k]) < n:
            step = np.uint64(pow(radix, len(_powers[k]), 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers[0], _powers[1]


def word_spans(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separators[buf]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def span_hashes(buf: np.ndarray, *spans: tuple[np.ndarray, np.ndarray], seed: int = 0) -> list[np.ndarray]:
    """64-bit hashes of byte spans, from prefix sums of a polynomial over per-byte random values; each seed has values of its own."""
    up, down = _grown(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_bytes_of(seed)[buf] * up[: len(buf)], out=total[1:])
    return [mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)) for s, e in spans]


def byte_blocks(texts, size: int = BLOCK):
    """Groups of (row numbers, UTF-8 texts) of about `size` bytes; a longer text is a group of its own."""
    rows, group, held = [], [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and held + len(data) > size:
            yield rows, group
            rows, group, held = [], [], 0
        rows.append(i)
        group.append(data)
        held += len(data) + 1
    if group:
        yield rows, group
