"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, n-gram bucket) in tasks over a bounded sample of the labelled rows (MAX_TRAIN_ROWS, drawn by a hash
of id and text) and sums them in a shuffle; the matrix of log-probabilities has languages x BUCKETS entries and is broadcast. A batch
of texts is scored as one sparse product in numpy: every n-gram position is a row number of the matrix, and the
rows of a text are added up, and to them the language's share of the sample's rows. Texts are read whole, however long, in segments of bounded size. Languages that
tie: the first by name.

Nulls and texts without a letter: `und` with score 0. A training table without labelled rows gives `und` for every text. Equal texts
have equal results. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash, mixed

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
MAX_TRAIN_ROWS = 20_000
TRAIN_TASKS = 16
SEGMENT = 1 << 18
SMOOTHING = 0.5

_letters: list = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _segments(texts):
    """Batches of (row numbers, code points, n-gram starts a row has there): a row's last two points are padding or the next segment's."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        points = np.frombuffer(("" if text is None else text).lower().encode("utf-32-le", "surrogatepass"), "<u4")
        for at in range(0, len(points), SEGMENT):
            part = np.full(min(SEGMENT, len(points) - at) + 2, 32, np.uint32)
            own = points[at : at + len(part)]
            part[: len(own)] = own
            if parts and held + len(part) > SEGMENT:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, parts


def _buckets(points: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per order, the bucket of the n-gram at every position; BUCKETS (no bucket) where a segment's padding stands."""
    letters = _is_letter()
    c = np.where(letters[np.minimum(points, 0x10FFFF)], points, 32).astype(np.uint64)
    skip = np.concatenate([ends - 1, ends - 2])
    out = []
    for n in ORDERS:
        key = c.copy()
        for k in range(1, n):
            key[:-k] |= c[k:] << np.uint64(21 * k)
        h = (mixed(key + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32)
        h[skip] = BUCKETS
        out.append(h)
    return out


def _sums(texts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its n-grams' weight rows, and whether it has a letter. weights: (BUCKETS + 1, k), last row 0."""
    total, lettered = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), bool)
    columns = [np.ascontiguousarray(weights[:, k]) for k in range(weights.shape[1])]
    for rows, parts in _segments(texts):
        points = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate([[0], ends[:-1]])
        np.logical_or.at(lettered, rows, np.logical_or.reduceat(_is_letter()[np.minimum(points, 0x10FFFF)], starts))
        for h in _buckets(points, ends):
            for k, column in enumerate(columns):
                np.add.at(total[:, k], rows, np.add.reduceat(column[h], starts, dtype=np.float64))
    return total, lettered


def sample_share(n: int, most: int) -> Column:
    """Whether a row is one of about `most` of `n` rows (all where there are fewer), by a hash of id and text: the same rows on every run."""
    return F.lit(True) if n <= most else F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * most / n)


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log-probabilities (BUCKETS + 1, languages) and the logs of their shares, from rows (doc_id, text, lang)."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sample = labelled.where(sample_share(labelled.count(), max_rows))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                own = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                docs[lang] = docs.get(lang, 0) + len(texts)
                for _, parts in _segments(texts.tolist()):
                    for h in _buckets(np.concatenate(parts), np.cumsum([len(p) for p in parts])):
                        own += np.bincount(h, minlength=BUCKETS + 1)
        for lang, own in held.items():
            at = np.flatnonzero(own[:BUCKETS])
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(own[at], docs[lang])})

    counts = sample.select("lang", "text").repartition(TRAIN_TASKS).mapInPandas(count, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most
    langs = sorted(counts["lang"].unique())
    table, rows = np.zeros((BUCKETS + 1, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        seen = np.full(BUCKETS, SMOOTHING)
        real = own[own["bucket"] >= 0]
        seen[real["bucket"]] += real["n"]
        table[:BUCKETS, k] = np.log(seen / seen.sum())
        rows[k] = own.loc[own["bucket"] < 0, "n"].sum()
    return langs, table, np.log(rows / rows.sum())


def predict(docs: DataFrame, trained: tuple[list[str], np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """`keep` columns of `docs` with lang_pred and the posterior probability of that language."""
    model = docs.sparkSession.sparkContext.broadcast(trained)

    def score(batches):
        names, weights, prior = model.value
        for pdf in batches:
            pred, prob = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            if names and len(pdf):
                total, lettered = _sums(pdf["text"].tolist(), weights)
                total += prior
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                best = odds.argmax(axis=1)
                pred = np.where(lettered, np.array(names, object)[best], "und")
                prob = np.where(lettered, odds[np.arange(len(pdf)), best], 0.0)
            out = pdf[keep].copy()
            out["lang_pred"], out["score"] = pred, prob
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInPandas(score, f"{schema}, lang_pred string, score double")


def op5_naive_bayes(docs: DataFrame) -> DataFrame:
    marked = docs.select("doc_id", "text", "lang", F.pmod(id_hash(), F.lit(4)).alias("part"))
    trained = train(marked.where("part <> 2"))
    return predict(marked.select("doc_id", "text", (F.col("part") == 2).alias("held_out")), trained, ["doc_id", "held_out"])
