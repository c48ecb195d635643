from pyspark.sql import functions as F

from strideframe.operators import association, ball, history, reconcile
from strideframe.plans.policy import AssociationPolicy, BallPolicy
from strideframe.sources import observations as S


def test_ball_interpolates_short_gaps_and_restarts_after_long_ones(spark):
    seen = {0: (0.0, 0.0), 1: (5.0, 0.0), 4: (20.0, 0.0), 5: (900.0, 0.0), 20: (30.0, 0.0)}
    rows = [(1, f, *seen.get(f, (None, None)), 0.5) for f in range(21)]
    got = sorted(map(tuple, ball.reconstruct(spark.createDataFrame(rows, "analysis_id long, frame long, x double, y double, confidence double"), BallPolicy()).collect()))
    assert [(r[1], r[2], r[4], r[5]) for r in got] == [(0, 0.0, 1, False), (1, 5.0, 1, False), (2, 10.0, 1, True), (3, 15.0, 1, True), (4, 20.0, 1, False), (20, 30.0, 2, False)]


OWN = "track_id long, player_id long, analysis_id long, first_us long, last_us long, first_x double, first_y double, last_x double, last_y double, area double, side string"


def fragment(track, first, last, x=0.0, side="NEAR", area=1.0, look=None, analysis=0):
    return (track, 0, analysis, int(first * 1e6), int(last * 1e6), x, 0.0, x, 0.0, area, side, look)


def edges_of(spark, *rows, gaps=None):
    df = spark.createDataFrame(list(rows), OWN + ", appearance array<double>")
    own = None if gaps is None else spark.createDataFrame(gaps, "track_id long, gap_us long")
    return {(r.from_track, r.to_track): r for r in association.association_edges(df, AssociationPolicy(), own).collect()}


def test_a_long_gap_needs_a_strong_likeness_and_long_fragments(spark):
    near, less = [0.97, (1 - 0.97**2) ** 0.5], [0.94, (1 - 0.94**2) ** 0.5]
    first = fragment(1, 0, 1, look=[1.0, 0.0])
    assert not edges_of(spark, first, fragment(2, 2.1, 3.1, look=less))
    (edge,) = edges_of(spark, first, fragment(2, 2.1, 3.1, look=near)).values()
    assert edge.similarity == 0.97 and edge.reasons[-2:] == ["appearance_histogram_consistent", "appearance_supported_reentry"]
    assert not edges_of(spark, first, fragment(2, 2.1, 2.4, look=near)) and not edges_of(spark, first, fragment(2, 2.1, 3.1)) and not edges_of(spark, first, fragment(2, 17, 18, look=near))
    assert edges_of(spark, first, fragment(2, 1.5, 1.6, look=less)) and edges_of(spark, first, fragment(2, 1.5, 1.6)) and edges_of(spark, first, fragment(2, 1.5, 1.6, look=[1.0]))
    assert not edges_of(spark, first, fragment(2, 1.5, 1.6, look=[0.5, 0.5]))


def test_the_speed_is_over_the_upper_median_interval_where_that_is_longer(spark):
    pair = fragment(1, 0, 1), fragment(2, 1.1, 2, x=5.0)
    assert not edges_of(spark, *pair)
    gaps = [(1, 100_000), (1, 300_000), (2, 400_000), (2, 500_000), (3, 9_000_000)]
    (edge,) = edges_of(spark, *pair, gaps=gaps).values()
    assert edge.speed == 5 / 0.4
    assert not edges_of(spark, *pair, gaps=[(1, 100_000)] * 3 + gaps[2:])
    assert not edges_of(spark, fragment(1, 0, 1), fragment(2, 1.5, 2, side="FAR")) and not edges_of(spark, fragment(1, 0, 1), fragment(2, 1.5, 2, area=1.8)) and not edges_of(spark, fragment(1, 0, 1), fragment(2, 1.5, 2, analysis=1))


def test_groups_equal_a_loop_over_the_edges_of_whole_analyses(spark):
    import random

    rng = random.Random(12)
    rows = []
    for t in range(160):
        start = rng.uniform(0, 60)
        rows.append(fragment(t, start, start + rng.choice([0.3, 2, 6]), x=rng.uniform(0, 12), side=rng.choice(["NEAR", "NEAR", "UNKNOWN", "FAR"]), area=rng.uniform(1, 2), look=rng.choice([None, [1.0, 0.0], [0.98, (1 - 0.98**2) ** 0.5]]), analysis=t % 2))
    df = spark.createDataFrame(rows, OWN + ", appearance array<double>")
    edges = association.association_edges(df, AssociationPolicy(short_gap=15.0))
    span = {r[0]: (r[3], r[4], r[10]) for r in rows}
    group = {t: {t} for t in span}
    for e in sorted(edges.collect(), key=lambda e: (e.gap_us, e.distance, e.area_ratio, e.from_track, e.to_track)):
        a, b = group[e.from_track], group[e.to_track]
        if a is b or any(min(span[x][1], span[y][1]) > max(span[x][0], span[y][0]) or {span[x][2], span[y][2]} == {"NEAR", "FAR"} for x in a for y in b):
            continue
        a |= b
        for t in b:
            group[t] = a
    got = {r.track_id: r.group_id for r in association.association_groups(df, edges).collect()}
    assert got == {t: min(g) for t, g in group.items()} and len(set(got.values())) < 120


def test_groups_do_not_join_fragments_that_overlap(spark):
    own = "track_id long, player_id long, analysis_id long, first_us long, last_us long, first_x double, first_y double, last_x double, last_y double, area double, side string"
    s = 1_000_000
    rows = [(1, 0, 0, 0, s, 0.0, 0.0, 1.0, 0.0, 1.0, "NEAR"), (2, 0, 0, 2 * s, 3 * s, 1.0, 0.0, 2.0, 0.0, 1.0, "NEAR"), (3, 0, 0, 2 * s, 4 * s, 3.0, 0.0, 3.0, 0.0, 1.0, "NEAR"), (4, 0, 0, 5 * s, 6 * s, 3.0, 0.0, 3.0, 0.0, 1.0, "FAR")]
    df = spark.createDataFrame(rows, own)
    edges = association.association_edges(df, AssociationPolicy(short_gap=15.0))
    assert {(r.from_track, r.to_track) for r in edges.collect()} == {(1, 2), (1, 3)}
    assert {r.track_id: r.group_id for r in association.association_groups(df, edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_split_gives_the_larger_half_to_recent(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "k long, t long")
    got = {r.t: r.split for r in history.chronological_split(df, ["k"], ["t"]).collect()}
    assert got == {0: "earlier", 1: "earlier", 2: "recent", 3: "recent", 4: "recent"}


def test_reconcile_names_every_difference(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k long, v int")
    b = spark.createDataFrame([(2, 5), (3, None), (4, 4)], "k long, v int")
    assert {r.k: r.status for r in reconcile.reconcile(a, b, "k", "v").collect()} == {1: "MISSING", 2: "MISMATCH", 3: "OK", 4: "ORPHAN"}


def test_observation_lines_round_trip_and_bad_lines(spark, tmp_path):
    good = '{"analysis_id": "a", "frame_index": 1, "timestamp_seconds": 0.5, "track_id": 2, "confidence": 0.9, "court_position": [3.0, 4.0], "inside_court": true}'
    (tmp_path / "o.jsonl").write_text(good + "\nnot json\n")
    kept = S.read_observations(spark, str(tmp_path / "o.jsonl"), "drop").where("track_id IS NOT NULL")
    assert [(r.court_x, r.court_y) for r in kept.collect()] == [(3.0, 4.0)]
    bad = S.read_observations(spark, str(tmp_path / "o.jsonl"), "keep").cache()
    assert bad.where(F.col("_corrupt_record").isNotNull()).count() == 1
    S.write_observations(kept, str(tmp_path / "out"))
    assert S.read_observations(spark, str(tmp_path / "out")).count() == 1


def test_low_movement_in_the_kitchen_is_not_idle(spark):
    from strideframe.operators import activity
    from strideframe.plans.policy import ActivityPolicy, Court

    places = {0: [(3.0, 18.0), (15.0, 26.0)], 1: [(3.0, 5.0), (15.0, 40.0)], 2: [(3.0, 15.0), (15.0, 40.0)]}
    rows = [(a, 10 * a + p, 10 * a + p, f, f * 100_000, *at, True) for a, own in places.items() for p, at in enumerate(own) for f in range(60)]
    obs = spark.createDataFrame(rows, "analysis_id long, player_id long, track_id long, frame_index long, ts_us long, court_x double, court_y double, inside boolean")
    rule = ActivityPolicy()
    states = activity.window_states(activity.window_features(obs, rule, Court()), rule).cache()
    idle, kept = (False, "IDLE", "STATIONARY"), (True, "UNKNOWN", "CONFLICTING_EVIDENCE,KITCHEN_LOW_MOVEMENT_SAFEGUARD")
    first = {r.analysis_id: r for r in states.where("win = 0").collect()}
    assert {a: (r.kitchen_players > 0, r.state, r.reason) for a, r in first.items()} == {0: kept, 1: idle, 2: kept}
    assert {a: r.kitchen_players for a, r in first.items()} == {0: 2, 1: 0, 2: 1}
    runs = {r.analysis_id: r for r in activity.state_intervals(states, rule).where("first_win = 0").collect()}
    assert runs[0].kitchen_players == 2 and runs[0].reasons == "CONFLICTING_EVIDENCE,KITCHEN_LOW_MOVEMENT_SAFEGUARD"


def test_even_split_omits_the_middle(spark):
    rows = [(k, i, i) for k, n in ((1, 5), (2, 3), (3, 11), (4, 4)) for i in range(n)] + [(4, 0, 9)]
    df = spark.createDataFrame(rows, "k long, id long, t long")
    got = {k: {} for k in (1, 2, 3, 4)}
    for r in history.even_split(df, ["k"], "id", "t").collect():
        got[r.k][r.id] = r.split
    e, s = "earlier", "recent"
    assert got[1] == {0: e, 1: e, 2: None, 3: s, 4: s} and got[2] == {0: None, 1: None, 2: None}
    assert got[3] == {3: e, 4: e, 5: e, 6: e, 7: s, 8: s, 9: s, 10: s}
    assert got[4] == {1: e, 2: e, 3: s, 0: s}


def test_two_detections_in_a_frame_count_once(spark):
    from strideframe.operators import movement as M
    from strideframe.plans.policy import EVENT_MOVEMENT, Court

    schema = "player_id long, frame_index long, ts_us long, track_id long, confidence double, court_x double, court_y double, inside boolean"
    walk = [(1, k, k * 100_000, 7, 0.9, float(k), 10.0, True) for k in range(10)]
    weaker = [(1, k, k * 100_000, 8, 0.2, 15.0, 30.0, True) for k in range(10)]
    row = M.movement_summary(spark.createDataFrame(walk + weaker, schema), EVENT_MOVEMENT, Court()).first()
    assert (row.observations, row.distance_feet, row.observed_seconds) == (10, 9.0, 0.9)


def test_a_busy_player_costs_the_same_per_row(spark):
    import time

    from strideframe.operators import movement as M
    from strideframe.plans.policy import EVENT_MOVEMENT, Court

    rows = spark.range(200_000).selectExpr(
        "1L AS player_id", "id AS frame_index", "id * 100000 AS ts_us", "7L AS track_id", "0.9D AS confidence", "cast(id % 20 AS double) AS court_x", "10.0D AS court_y", "id % 3 <> 0 AS inside"
    )
    began = time.time()
    assert M.movement_summary(rows, EVENT_MOVEMENT, Court()).first().observations == 200_000
    assert time.time() - began < 60


def test_a_null_version_does_not_make_its_predecessor_current(spark):
    from strideframe.operators.reconcile import current_version

    rows = spark.createDataFrame([(1, None), (1, 3), (1, 5), (2, None)], "key long, v long")
    got = {(r.key, r.v): r.is_current for r in current_version(rows, ["key"], ["v"]).collect()}
    assert got == {(1, None): False, (1, 3): False, (1, 5): True, (2, None): True}
