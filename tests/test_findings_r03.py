"""Findings of round 3 that were left: steps whose cost grew with the number of groups, of pairs or of labelled rows."""

import random

from strideframe.operators import association, merge_log
from strideframe.plans.policy import AssociationPolicy


def test_f11_to_f13_components_are_replayed_in_streams_whatever_the_batches(spark):
    rng = random.Random(4)
    candidates = [(c, p, [100 * c + 2 * p, 100 * c + 2 * p + 1], rng.random() < 0.3, None) for c in range(9) for p in range(6)]
    log = [(c, 6 + k, "MERGE", [t for p in rng.sample(range(6), 2) for t in (100 * c + 2 * p, 100 * c + 2 * p + 1)]) for c in range(9) for k in range(8)]
    rows = lambda: merge_log.replay(spark.createDataFrame(candidates, "collection_id long, place long, tracks array<long>, rejected boolean, reason string"), spark.createDataFrame(log, "collection_id long, seq long, action string, tracks array<long>"))
    want = rows()
    assert "CoGroups" not in want._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(repr, rows().collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(repr, want.collect())) and len([r for r in got if "kind='merge'" in r]) == 72


def _plain(fragments, edges):
    """Groups by taking edges one after another."""
    group, span = {r.track_id: r.track_id for r in fragments}, {r.track_id: r for r in fragments}
    for e in sorted(edges, key=lambda r: [r[c] for c in association.EDGE_ORDER]):
        a, b = group[e.from_track], group[e.to_track]
        own = [[span[t] for t in group if group[t] == g] for g in (a, b)]
        clash = any(min(x.last_us, y.last_us) > max(x.first_us, y.first_us) or {x.side, y.side} == {"NEAR", "FAR"} for x in own[0] for y in own[1])
        if a != b and not clash:
            group = {t: min(a, b) if g in (a, b) else g for t, g in group.items()}
    return group


def test_f2_groups_of_bands_and_rounds_equal_edges_taken_one_by_one(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for t in range(60):
        at = rng.randrange(60_000_000)
        rows.append((t, t % 2, at, at + rng.choice([0, 0, 1_000_000, 9_000_000]), *[rng.random() * 9 for _ in range(4)], 1.0 + rng.random(), rng.choice(["NEAR", "FAR", "UNKNOWN", "UNKNOWN"])))
    df = spark.createDataFrame(rows, "track_id long, analysis_id long, first_us long, last_us long, first_x double, first_y double, last_x double, last_y double, area double, side string")
    rule = AssociationPolicy(short_gap=15.0, speed=1e3)
    edges = association.association_edges(df, rule)
    want = _plain(df.collect(), edges.collect())
    assert len(set(want.values())) < 40
    monkeypatch.setattr(association, "FOLD_LINKS", 3)
    assert {r.track_id: r.group_id for r in association.association_groups(df, edges, rule).collect()} == want
    monkeypatch.setattr(association, "BAND_FRAGMENTS", 8)
    monkeypatch.setattr(association, "FOLD_LINKS", 8)
    assert {r.track_id: r.group_id for r in association.grouped_fragments(df, rule).collect()} == want
