"""Filter interaction audit: what every order of five filters removes, from the counts of failure masks.

Each document gets a mask of the filters it fails. Documents are counted by part and mask, at most 32 cells a part whatever the input, and a
part's 120 orders are visited by swaps of neighbours: a swap changes two steps only, which are counted anew from the cells. Removals are added
up along the walk, which gives each filter's Shapley sum.

Filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * capitals A-Z > 10 * code points; D any of #$%&*|; E a text that a row
with a smaller doc_id has too. Words are maximal runs of anything but the six ASCII spaces.

Copies are found from digests: the smallest doc_id of each digest is aggregated before the shuffle, and groups of more than a thousandth of all
rows meet their rows by a broadcast (`with_group`).

Nulls: a null text is empty, a null language is the part ''. A null doc_id is larger than none and smaller than none, so such rows never fail E
and have no labels. Repeated rows: each counts; rows that share the smallest doc_id of their text all stay. Repeated labels of a doc_id: one that
is 1 is enough. Very long texts are ordinary rows. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, with_group

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def plain_changes(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """All orders of n things, each from the one before by a swap of places p and p + 1; yields (order, p), None for the first."""
    order, heading = list(range(n)), [-1] * n
    yield tuple(order), None
    while True:
        place = {x: i for i, x in enumerate(order)}
        movable = [x for x in order if 0 <= place[x] + heading[x] < n and order[place[x] + heading[x]] < x]
        if not movable:
            return
        top = max(movable)
        i, j = place[top], place[top] + heading[top]
        order[i], order[j] = order[j], order[i]
        for x in range(top + 1, n):
            heading[x] = -heading[x]
        yield tuple(order), min(i, j)


def audit(masks: np.ndarray, cells: np.ndarray, n: int = len(FILTERS)) -> tuple[list[tuple[tuple[int, ...], np.ndarray]], np.ndarray, np.ndarray]:
    """Orders with their steps (kept, removed, redundant, good lost, toxic lost), Shapley sums and unique failures per filter.

    `cells` has a row per mask: documents, good ones, toxic ones.
    """
    fails = [(masks >> f & 1).astype(bool) for f in range(n)]
    steps, walk, shapley = np.zeros((n, 5), np.int64), [], np.zeros(n, np.int64)

    def count(order, p):
        before = sum(1 << f for f in order[:p])
        fresh, own = (masks & before) == 0, fails[order[p]]
        lost = cells[fresh & own].sum(axis=0)
        steps[p] = cells[fresh & ~own, 0].sum(), lost[0], cells[~fresh & own, 0].sum(), lost[1], lost[2]

    for order, p in plain_changes(n):
        for k in range(n) if p is None else (p, p + 1):
            count(order, k)
        walk.append((order, steps.copy()))
        np.add.at(shapley, list(order), steps[:, 1])
    unique = np.array([cells[masks == 1 << f, 0].sum() for f in range(n)])
    return walk, shapley, unique


def _audit_part(cells: pd.DataFrame) -> pd.DataFrame:
    walk, shapley, unique = audit(cells["mask"].to_numpy(), cells[["docs", "good", "toxic"]].to_numpy(np.int64))
    part, rows = cells["part"].iloc[0], []
    for order, steps in walk:
        name = "".join(FILTERS[f] for f in order)
        for k, (kept, removed, redundant, good, toxic) in enumerate(steps.tolist()):
            f = order[k]
            rows.append((part, name, k + 1, kept, removed, redundant, int(unique[f]), good, toxic, int(shapley[f])))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's digest and the mask of filters A to D."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    df = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), words.alias("w"))
    n_words, n_distinct = F.size("w"), F.size(F.array_distinct("w"))
    checks = (
        n_words < 100,
        n_distinct.cast("long") * 100 < n_words.cast("long") * 80,
        F.regexp_count("t", F.lit("[A-Z]")).cast("long") * 100 > F.length("t").cast("long") * 10,
        F.col("t").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(checks)), F.lit(0))
    return df.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per part and mask."""
    rows = saved(text_masks(docs), "masks")
    total = rows.count()
    groups = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("group_size")), "groups")
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    # written, so that a doc_id with many rows is split by AQE in the join
    flags = saved(flags.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), "flags")
    marked = with_group(rows, groups, ["digest"], "group_size", total).join(flags, "doc_id", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")]
    return marked.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("docs"), *sums)


def op12_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    # a part has at most 32 cells
    return cells(docs, labels).groupBy("part").applyInPandas(_audit_part, SCHEMA)
