"""Document fingerprints: threshold-scaled sketches of 5-word shingles.

A sketch keeps every distinct shingle hash below 1 / SCALED of the hash range, so its size follows the document's, the sketch of a union is the
union of sketches (`merged`), and the part of a small document that lies in a large one can be told from the two sketches alone
(`containment`), which samples of fixed size can't do. If no hash is below the threshold the least one is kept, so only texts without words have
an empty sketch; merging keeps that rule. A shingle is five words lower-cased for A-Z; a text of fewer words is one shingle.

Hashes have 48 bits. As text, a sketch is its hashes in ascending order, eight base64 characters each.

The likeness of two sketches is the larger of the two containments, the shared hashes over the smaller sketch: 1 for equal sketches, two empty ones
included, and 0 where just one is empty.

`op11_sketches` compares each document with its successor in descending doc_id, nulls last, and the last with the first. Rows are sorted by range
once, and every task reads its rows as a stream, so that a successor is the next row; only a task's first and last row are matched outside, two
rows per task. Equal doc_ids are ordered by a hash of their text, then by their place in the input: a doc_id with very many rows is split over tasks
like any range. A single row is its own successor.

Nulls: a null text is empty. Repeated rows are separate rows. Texts are read whole, however long. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .jaccard_join import shingle_sets

SCALED = 10
BITS = 48
BATCH_BYTES = 4 << 20
SKETCH = "sketch array<long>"
PAIRS = "part int, place int, doc_id long, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double, text string"


def reduced(hashes: np.ndarray, scaled: int = SCALED) -> np.ndarray:
    """The ascending hashes that a sketch keeps of ascending distinct 48-bit hashes."""
    low = hashes[: np.searchsorted(hashes, -(-(1 << BITS) // scaled))]
    return low if len(low) else hashes[:1]


def sketches(texts: list[str | None], scaled: int = SCALED) -> list[np.ndarray]:
    """The sketch of each text."""
    out: list = [None] * len(texts)
    for rows, sizes, hashes in shingle_sets(texts):
        ends = np.cumsum(sizes)
        for row, start, end in zip(rows.tolist(), (ends - sizes).tolist(), ends.tolist()):
            own = hashes[start:end] >> np.uint64(64 - BITS)
            out[row] = reduced(own if len(own) < 2 else own[np.concatenate([[True], own[1:] != own[:-1]])], scaled)
    return out


def merged(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> np.ndarray:
    """The sketch of the union of the two documents' shingles."""
    return reduced(np.union1d(a, b), scaled)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated part of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The containment of the smaller sketch in the larger."""
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def packed(sketch: np.ndarray) -> bytes:
    """Six bytes a hash, the highest first."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()


def encoded(sketch: np.ndarray) -> str:
    """The sketch as text."""
    return base64.b64encode(packed(sketch)).decode()


def decoded(text: str) -> np.ndarray:
    """The sketch of encoded()."""
    held = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    return np.pad(held, ((0, 0), (8 - BITS // 8, 0))).reshape(-1).view(">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as many characters from the start of `following`, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str], following: list[str], own: list[np.ndarray], after: list[np.ndarray]) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    rows = []
    for doc_id, text, new, a, b, c in zip(ids, texts, changed, own, sketches(changed), after):
        rows.append((None, None, doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), packed(a), packed(b), likeness(a, b), likeness(a, c), None))
    return rows


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in PAIRS.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _arrow_schema()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a few MB at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the rows whose successor is in the task; its first (place 0) and last row (place 1) with their texts."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None
    for ids, texts in _runs(batches):
        own = sketches(texts)
        if last is None:
            yield _batch([(part, 0, ids[0], *[None] * 6, texts[0])])
        else:
            ids, texts, own = [last[0], *ids], [last[1], *texts], [last[2], *own]
        last = ids[-1], texts[-1], own[-1]
        if len(ids) > 1:
            yield _batch(_compared(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]))
    if last is not None:
        yield _batch([(part, 1, last[0], *[None] * 6, last[1])])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            yield _batch(_compared([doc_id], [text], [following], sketches([text]), sketches([following])))


def compared_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the two sketches packed (own, edited), near_edited and near_next."""
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"))
    run = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = saved(run.mapInArrow(_neighbours, PAIRS), "neighbours")
    edges = found.where(F.col("part").isNotNull())
    parts = sorted(r["part"] for r in edges.where("place = 0").select("part").collect())  # numbers of tasks
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    firsts = edges.where("place = 0").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    pairs = edges.where("place = 1").select("part", "doc_id", "text").join(follows, "part").join(firsts, "next_part")
    columns = ["doc_id", "n_chars", "edited_sha256", "own", "edited", "near_edited", "near_next"]
    inner = found.where(F.col("part").isNull()).select(columns)
    return inner.unionByName(pairs.select("doc_id", "text", "following").mapInArrow(_edges, PAIRS).select(columns))


def op11_sketches(docs: DataFrame) -> DataFrame:
    df = compared_with_next(docs)
    text = [F.regexp_replace(F.base64(c), "[\r\n]", "").alias(n) for c, n in (("own", "fingerprint"), ("edited", "edited_fingerprint"))]
    return df.select("doc_id", "n_chars", "edited_sha256", *text, "near_edited", "near_next")
