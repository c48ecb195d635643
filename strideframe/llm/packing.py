"""Packing token sequences by minimum bin slack.

A document is its byte-level BPE ids and one closing id 0. Every full window of 1024 ids is a sequence of its own; what remains of a document,
1 to 1023 ids, is one of at most 1023 lengths. Only the histogram of these lengths goes to the driver (1023 numbers, whatever the
input), where the plan is made: the longest remaining length opens a window, and a subset-sum dynamic programme over bitsets of
reachable sums picks the multiset of remaining lengths that fills the window closest to capacity; the counts are found by
walking the bitsets back. The same multiset is used for as many windows as its lengths allow, so the plan has a few thousand lines
at most. Spark then ranks the remainders of each length and looks the rank up in the plan.

Ranks need no task per length: a length's rows are numbered in runs (length, salt), and the runs' first numbers are sums of counts.

Nulls: a null text is empty and packs as the single closing id. Rows that repeat are packed once each; the pieces then repeat too. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WINDOW = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: From this many characters of white space on `tiktoken`'s pattern may run out of stack.
LONG_RUN = 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")

_encoders: dict = {}
_whole_encoders: dict = {}


def special_tokens(tokenizer_path: str) -> dict[str, int]:
    """The ids of the special added tokens of a tokenizers file."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}


def _whole_encoder(ranks_path: str, with_specials: bool):
    """`tokenizers` over the vocabulary's .json beside the ranks: slower, but white space of any length is no deep recursion to it."""
    key = (ranks_path, with_specials)
    if key not in _whole_encoders:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(str(Path(ranks_path).with_suffix(".json")))
        whole.encode_special_tokens = not with_specials
        _whole_encoders[key] = whole
    return lambda text: _whole_encoders[key].encode(text, add_special_tokens=False).ids


def encoder(ranks_path: str, specials: dict[str, int] | None = None):
    """A function from text to ids: tiktoken over the vocabulary file `ranks_path`; the strings of `specials` get their ids, without them they are ordinary text."""
    specials = specials or {}
    key = (ranks_path, *sorted(specials.items()))
    if key not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        ranks = {token: rank for token, rank in ranks.items() if rank not in specials.values()}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)

        def encode(text: str) -> list[int]:
            if len(text) > LONG_RUN and _LONG_SPACE.search(text):
                return _whole_encoder(ranks_path, bool(specials))(text)
            # the plain call is the faster one
            return encoding.encode(text, allowed_special="all") if any(s in text for s in specials) else encoding.encode_ordinary(text)

        _encoders[key] = encode
    return _encoders[key]


def pieces(docs: DataFrame, ranks_path: str, window: int = WINDOW, specials: dict[str, int] | None = None) -> DataFrame:
    """Every document's ids cut at multiples of `window`: doc_id, start, length, crc32 of the ids, the document's ids in all."""

    def cut(batches):
        encode = encoder(ranks_path, specials)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                out += [(doc_id, at, len(p := ids[at : at + window]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), window)]
            out = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def fill(counts: dict[int, int], room: int) -> Counter:
    """The multiset of available lengths with the largest sum of at most `room` (longer lengths first among equals)."""
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            step = min(step, left)
            trail.append((length, step, reach))
            reach |= (reach << length * step) & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, Counter()
    for length, step, before in reversed(trail):
        if not before >> total & 1:
            used[length] += step
            total -= length * step
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, Counter]]:
    """Lines (windows, lengths with their counts in each) that use up the histogram."""
    counts, lines = {k: n for k, n in histogram.items() if n}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        used = fill({k: n for k, n in counts.items() if n}, window - first)
        counts[first] += 1
        used[first] += 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
        lines.append((times, used))
    return lines


def plan_rows(lines: list[tuple[int, Counter]], first_sequence: int) -> list[tuple[int, int, int, int, int, int]]:
    """Per line and length: length, its first and one past its last rank, copies per window, first sequence, offset of the first copy."""
    rows, next_rank, sequence = [], Counter(), first_sequence
    for times, used in lines:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, next_rank[length], next_rank[length] + times * n, n, sequence, offset))
            next_rank[length] += times * n
            offset += length * n
        sequence += times
    return rows


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds `rank`, from 0 without gaps within each value of `key`, of which there are few; no task holds a whole value."""
    salts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    runs = df.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_start"))
    own = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1
    return df.join(runs, [key, "salt"]).withColumn("rank", F.col("run_start") + own).drop("salt", "run_start")


def pack(docs: DataFrame, ranks_path: str, window: int = WINDOW, specials: dict[str, int] | None = None) -> DataFrame:
    """Every piece of every document with the sequence it goes to and its offset there."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, ranks_path, window, specials), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `window` rows at most
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    full = ranked(cut.where(F.col("length") == window), "length", order)
    full = full.select(*cut.columns, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_full = counts.pop(window, 0)
    schema = "length long, low long, high long, per long, first long, at long"
    # at most window**2 / 2 lines of six numbers, whatever the input
    lines = F.broadcast(spark.createDataFrame(plan_rows(plan(counts, window), n_full), schema))
    rest = ranked(cut.where(F.col("length") < window), "length", order).alias("r")
    own = F.col("rank") - F.col("low")
    joined = rest.join(lines.alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = joined.select(
        *[F.col(f"r.{c}") for c in cut.columns],
        (F.col("first") + F.floor(own / F.col("per"))).alias("sequence_id"),
        (F.col("at") + own % F.col("per") * F.col("r.length")).alias("offset"),
    )
    return full.unionByName(placed)


def op2_bin_slack(docs: DataFrame, ranks_path: str, specials: dict[str, int] | None = None) -> DataFrame:
    return pack(docs, ranks_path, specials=specials)
