"""Manual merges of candidates as an ordered log: what each entry does, the groups after a replay, and what a regrouping keeps of earlier reviews.

A log has rows (collection_id, seq, action, tracks): MERGE joins the candidates of these tracks into one, UNDO takes back every earlier MERGE of exactly
these tracks. Candidates are rows (collection_id, place, tracks, rejected, reason), disjoint sets of tracks in the order of their list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .components import components

REPLAYED = "kind string, collection_id long, seq long, place long, tracks array<long>, rejected boolean, reason string"
#: Given where a merged candidate is rejected and none of its sources says why.
NO_REASON = "not_a_player"


def track_set(column: str = "tracks") -> Column:
    """The tracks as a set that compares: sorted, each once."""
    return F.sort_array(F.array_distinct(column))


def merge_entries(pairs: DataFrame, candidates: DataFrame, seq: Column) -> DataFrame:
    """Log entries for pairs (collection_id, first_place, second_place) of different candidates: their tracks together."""
    own = candidates.select("collection_id", "place", "tracks")
    joined = pairs.where("first_place <> second_place")
    for side in ("first", "second"):
        joined = joined.join(own.select("collection_id", F.col("place").alias(f"{side}_place"), F.col("tracks").alias(f"{side}_tracks")), ["collection_id", f"{side}_place"])
    return joined.select("collection_id", seq.cast("long").alias("seq"), F.lit("MERGE").alias("action"), F.array_sort(F.array_union("first_tracks", "second_tracks")).alias("tracks"))


def standing(log: DataFrame) -> DataFrame:
    """Adds `state`: a MERGE is ACTIVE or UNDONE by a later UNDO of its tracks; an UNDO is DONE or, without an active MERGE to take back, NOT_FOUND."""
    log = log.withColumn("tracks", track_set())
    own = Window.partitionBy("collection_id", "tracks")
    last_undo = F.max(F.when(F.col("action") == "UNDO", F.col("seq"))).over(own)
    before = F.lag("action").over(own.orderBy("seq"))
    merge = F.when(last_undo > F.col("seq"), "UNDONE").otherwise("ACTIVE")
    return log.withColumn("state", F.when(F.col("action") == "MERGE", merge).when(before == "MERGE", "DONE").otherwise("NOT_FOUND"))


def _replay_component(base: list[tuple], log: list[tuple]) -> list[tuple]:
    """REPLAYED rows: candidates after the active merges in their order; every merge with whether it applied (place 1) or not (0).

    `base` (collection_id, place, tracks, rejected, reason) and `log` (collection_id, seq, tracks) are in order.
    """
    current = [(None, place, frozenset(tracks), rejected, reason, c) for c, place, tracks, rejected, reason in base]
    rows = []
    for c, seq, own in log:
        tracks = frozenset(own)
        source = [x for x in current if x[2] <= tracks]
        applies = sum(len(x[2]) for x in source) == len(tracks)
        rows.append(("merge", c, seq, int(applies), sorted(tracks), None, None))
        if applies:
            rejected = any(x[3] for x in source)
            reason = next((x[4] for x in source if x[4] is not None), NO_REASON) if rejected else None
            current = [x for x in current if x not in source] + [(seq, None, tracks, rejected, reason, c)]
    return rows + [("candidate", x[5], x[0], x[1], sorted(x[2]), x[3], x[4]) for x in current]


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replays components that lie behind each other, each with its candidates before its merges; holds one component and one batch."""

    def frame(rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REPLAYED.split(", ")]).astype({"seq": "Int64", "place": "Int64"})

    at, base, log = None, [], []
    for pdf in batches:
        out = []
        columns = (pdf[c].tolist() for c in ("c1", "c2", "merge", "at", "collection_id", "tracks", "rejected", "reason"))
        for component, rows in groupby(zip(*columns), lambda r: r[:2]):
            if component != at:
                out += _replay_component(base, log)
                at, base, log = component, [], []
            for _, _, merge, place, c, tracks, rejected, reason in rows:
                if merge:
                    log.append((c, place, tracks.tolist()))
                else:
                    base.append((c, place, tracks.tolist(), bool(rejected), reason))
        yield frame(out)
    yield frame(_replay_component(base, log))


def replay(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """REPLAYED rows: the candidates that the active merges leave (seq of the merge that made it, or its place in the list), and each active merge.

    A merge applies if the current candidates that lie within its tracks cover them all, so merges depend on each other only through shared
    tracks: each connected component of tracks is replayed by itself, and a collection with many merges spreads over many tasks. The components come
    to the tasks in order, behind each other, so that a small one costs no call of its own. A log with `state` is taken as standing() gave it.
    """
    log = (log if "state" in log.columns else standing(log)).where("state = 'ACTIVE'").select("collection_id", "seq", "tracks")
    log = written(log, "active-merges")
    base = candidates.select("collection_id", "place", track_set().alias("tracks"), "rejected", "reason")
    node = lambda t: F.struct(F.col("collection_id"), t.alias("track"))
    sets = base.select("collection_id", "tracks").unionByName(log.select("collection_id", "tracks")).distinct()
    star = sets.select(node(F.col("tracks")[0]).alias("u"), "collection_id", F.explode("tracks").alias("t")).select("u", node(F.col("t")).alias("v"))
    found = components(star).select("node", F.col("component.collection_id").alias("c1"), F.col("component.track").alias("c2"))
    entries = base.withColumnRenamed("place", "at").withColumn("merge", F.lit(False))
    entries = entries.unionByName(log.withColumnRenamed("seq", "at").withColumn("merge", F.lit(True)), allowMissingColumns=True)
    placed = entries.withColumn("node", node(F.col("tracks")[0])).join(found, "node").drop("node")
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: few bytes, but Python's time
    return placed.repartition(tasks, "c1", "c2").sortWithinPartitions("c1", "c2", "merge", "at").mapInPandas(_replayed, REPLAYED)


def membership(replayed: DataFrame) -> DataFrame:
    """(collection_id, track_id, group_id): each track with its candidate's smallest track."""
    rows = replayed.where("kind = 'candidate'")
    return rows.select("collection_id", F.explode("tracks").alias("track_id"), F.col("tracks")[0].alias("group_id"))


def carried_rejections(candidates: DataFrame, previous: DataFrame) -> DataFrame:
    """`candidates` (…, candidate_id, place, tracks) with `rejected` and `reason` where an eligible candidate of `previous` (…, place, tracks,
    eligible, rejected, reason) with the same tracks was rejected; of several the last in the list decides."""
    prior = previous.where("eligible AND rejected").select("collection_id", track_set().alias("set"), "place", "reason")
    prior = prior.groupBy("collection_id", "set").agg(F.max_by(F.struct("reason"), "place").alias("prior"))
    joined = candidates.withColumn("set", track_set()).join(prior, ["collection_id", "set"], "left")
    return joined.select(*candidates.columns, F.col("prior").isNotNull().alias("rejected"), F.col("prior.reason").alias("reason"))


def carried_selection(candidates: DataFrame, previous: DataFrame, selected: DataFrame, legacy: DataFrame) -> DataFrame:
    """(collection_id, candidate_id, how): the candidate that a collection's choice passes to.

    `selected` (collection_id, selected_id) passes by ID where that candidate is still there, else by TRACKS to the first candidate in the list with just the tracks it
    had. Collections without earlier candidates take the first one that holds the track of `legacy` (collection_id, track_id), LEGACY. The
    candidates' tracks are inverted into a member index, so that a lookup is a join on the track. No row: nothing passes.
    """
    own = candidates.select("collection_id", "candidate_id", "place", track_set().alias("set"))
    by_id = selected.join(own, (own.collection_id == selected.collection_id) & (own.candidate_id == selected.selected_id)).select(selected.collection_id, "candidate_id", F.lit("ID").alias("how"))
    prior = previous.select("collection_id", F.col("candidate_id").alias("selected_id"), track_set().alias("set"), F.col("place").alias("at"))
    prior = selected.join(prior, ["collection_id", "selected_id"]).groupBy("collection_id").agg(F.min_by("set", "at").alias("set"))
    by_set = prior.join(own, ["collection_id", "set"]).groupBy("collection_id").agg(F.min_by("candidate_id", "place").alias("candidate_id"))
    by_set = by_set.join(by_id.select("collection_id"), "collection_id", "left_anti").withColumn("how", F.lit("TRACKS"))
    members = own.select("collection_id", "candidate_id", "place", F.explode("set").alias("track_id"))
    first = legacy.join(previous.select("collection_id").distinct(), "collection_id", "left_anti").join(members, ["collection_id", "track_id"])
    by_track = first.groupBy("collection_id").agg(F.min_by("candidate_id", "place").alias("candidate_id")).withColumn("how", F.lit("LEGACY"))
    return by_id.unionByName(by_set).unionByName(by_track)
