"""Logs of manual merges against a plain replay of whole collections."""

import random

from strideframe.operators.components import components
from strideframe.operators.merge_log import carried_rejections, carried_selection, merge_entries, replay, standing

CANDIDATES = "collection_id long, place long, tracks array<long>, rejected boolean, reason string"
LOG = "collection_id long, seq long, action string, tracks array<long>"


def plain(candidates, log):
    """Entry by entry: the active merges of the whole log first, then all of them in order on the list of candidates."""
    out, states = [], {}
    for c in {r[0] for r in candidates}:
        active = []
        for _, seq, action, tracks in sorted(r for r in log if r[0] == c):
            key = frozenset(tracks)
            if action == "MERGE":
                active.append((seq, key))
            else:
                states[c, seq] = "DONE" if any(k == key for _, k in active) else "NOT_FOUND"
                for s, k in active:
                    if k == key:
                        states[c, s] = "UNDONE"
                active = [x for x in active if x[1] != key]
        held = [(None, frozenset(t), bad, why) for _, _, t, bad, why in sorted(r for r in candidates if r[0] == c)]
        for seq, key in active:
            source = [h for h in held if h[1] <= key]
            applies = set().union(*[h[1] for h in source]) == key
            states[c, seq] = "APPLIED" if applies else "SKIPPED"
            if applies:
                bad = any(h[2] for h in source)
                why = ([h[3] for h in source if h[3]] + ["not_a_player"])[0] if bad else None
                held = [h for h in held if h not in source] + [(seq, key, bad, why)]
        out += [(c, s, tuple(sorted(t)), bad, why) for s, t, bad, why in held]
    return sorted(out, key=repr), states


def test_replay_equals_the_plain_one_on_random_logs(spark):
    rng = random.Random(11)
    candidates, log = [], []
    for c in range(25):
        tracks = rng.sample(range(100), 12)
        while tracks:
            own = [tracks.pop() for _ in range(min(len(tracks), rng.randint(1, 3)))]
            bad = rng.random() < 0.25
            candidates.append((c, len(candidates), own, bad, rng.choice([None, "spectator"]) if bad else None))
        sets = [[t for r in rng.sample([r for r in candidates if r[0] == c], rng.randint(2, 3)) for t in r[2]] for _ in range(4)]
        sets += [sets[0] + sets[1], sets[1] + [999], sets[2][:-1]]
        for _ in range(30):
            log.append((c, len(log), rng.choice(["MERGE", "MERGE", "UNDO"]), rng.sample(s := rng.choice(sets), len(s))))
    want, states = plain(candidates, log)
    rows = replay(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(log, LOG)).collect()
    got = sorted([(r.collection_id, r.seq, tuple(r.tracks), r.rejected, r.reason) for r in rows if r.kind == "candidate"], key=repr)
    assert got == want
    found = {(r.collection_id, r.seq): r.state for r in standing(spark.createDataFrame(log, LOG)).collect()}
    found |= {(r.collection_id, r.seq): "APPLIED" if r.place else "SKIPPED" for r in rows if r.kind == "merge"}
    assert found == states and set(states.values()) == {"APPLIED", "SKIPPED", "UNDONE", "DONE", "NOT_FOUND"}


def test_an_undo_in_the_middle_lets_later_merges_build_anew(spark):
    candidates = [(1, 0, [1], False, None), (1, 1, [2], True, None), (1, 2, [3], False, None), (1, 3, [4], False, None)]
    log = [(1, 0, "MERGE", [1, 2]), (1, 1, "MERGE", [3, 1, 2]), (1, 2, "UNDO", [2, 1]), (1, 3, "MERGE", [3, 4])]
    rows = replay(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(log, LOG))
    assert {(tuple(r.tracks), r.seq, r.rejected, r.reason) for r in rows.where("kind = 'candidate'").collect()} == {((1, 2, 3), 1, True, "not_a_player"), ((4,), None, False, None)}
    assert {(r.seq, r.place) for r in rows.where("kind = 'merge'").collect()} == {(1, 1), (3, 0)}


def test_entries_join_the_tracks_of_two_candidates(spark):
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 0, 9)], "collection_id long, first_place long, second_place long")
    (row,) = merge_entries(pairs, spark.createDataFrame([(1, 0, [5, 2], False, None), (1, 1, [3, 2], False, None)], CANDIDATES), F.lit(7)).collect()
    assert (row.seq, row.action, row.tracks) == (7, "MERGE", [2, 3, 5])


def test_reviews_and_choices_survive_a_regrouping(spark):
    own = "collection_id long, candidate_id string, place long, tracks array<long>"
    after = spark.createDataFrame([(1, "a", 0, [1, 2]), (1, "b", 1, [3]), (2, "n", 0, [7, 6]), (2, "m", 1, [6, 7]), (3, "x", 0, [4]), (3, "y", 1, [4, 5]), (4, "z", 0, [1])], own)
    before = spark.createDataFrame(
        [(1, "b", 0, [2, 1], True, True, "first"), (1, "c", 1, [1, 2, 2], True, True, "last"), (1, "d", 2, [3], False, True, "no"), (2, "old", 0, [7, 6], True, False, None), (4, "gone", 0, [1, 9], True, True, None)],
        own + ", eligible boolean, rejected boolean, reason string",
    )
    kept = {r.candidate_id: (r.rejected, r.reason) for r in carried_rejections(after, before).collect()}
    assert kept == {"a": (True, "last"), "b": (False, None), "n": (False, None), "m": (False, None), "x": (False, None), "y": (False, None), "z": (False, None)}
    selected = spark.createDataFrame([(1, "b"), (2, "old"), (4, "gone")], "collection_id long, selected_id string")
    legacy = spark.createDataFrame([(3, 4), (1, 3)], "collection_id long, track_id long")
    got = {tuple(r) for r in carried_selection(after, before, selected, legacy).collect()}
    assert got == {(1, "b", "ID"), (2, "n", "TRACKS"), (3, "x", "LEGACY")}


def test_components_of_paths_stars_and_loners(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7000, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 7000: 7000}
