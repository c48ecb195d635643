"""Primitives against literal numbers and brute force."""

import random

from pyspark.sql import functions as F

from strideframe.functions import geometry as G
from strideframe.operators import windows as W
from strideframe.plans.policy import Court


def test_upper_median_is_the_element_at_half(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 3), ("b", 1), ("b", 2), ("c", None)], "k string, v int")
    assert {r.k: r.m for r in df.groupBy("k").agg(W.upper_median(F.col("v")).alias("m")).collect()} == {"a": 9, "b": 2, "c": None}


def test_sessions_split_only_above_the_gap(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 21), ("b", 0)], "k string, t long")
    got = [(r.k, r.t, r.segment) for r in W.sessions(df, ["k"], "t", 10).orderBy("k", "t").collect()]
    assert got == [("a", 0, 0), ("a", 10, 0), ("a", 21, 1), ("b", 0, 0)]


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 9, 9), ("a", 8, 10)], "k string, s long, e long")
    assert sorted((r.s, r.e) for r in W.islands(df, ["k"], "s", "e").collect()) == [(0, 7), (8, 10)]


def test_concurrency_matches_brute_force(spark):
    rng = random.Random(0)
    rows = [(k, s, s + rng.randint(0, 12)) for k in range(4) for s in (rng.randint(0, 40) for _ in range(12))]
    got = {r.k: r.length for r in W.concurrency(spark.createDataFrame(rows, "k long, s long, e long"), ["k"], "s", "e", 2).collect()}
    for k in range(4):
        assert got[k] == sum(sum(s <= t < e for j, s, e in rows if j == k) >= 2 for t in range(60))


def test_clipped_intervals_cover_their_length(spark):
    df = spark.createDataFrame([(1, 5, 25), (2, 10, 20), (3, 7, 7)], "k long, s long, e long")
    got = W.clipped(df, "s", "e", 10).collect()
    assert sorted((r.k, r.win, r.clip_start, r.clip_end) for r in got) == [(1, 0, 5, 10), (1, 1, 10, 20), (1, 2, 20, 25), (2, 1, 10, 20)]


def test_zones_and_homography(spark):
    df = spark.createDataFrame([(10.0, 22.0), (10.0, 29.0), (10.0, 30.0), (10.0, 44.0)], "x double, y double")
    assert [r[0] for r in df.select(G.zone(F.col("y"), Court())).collect()] == ["kitchen", "kitchen", "transition", "baseline"]
    x, y = G.homography(F.col("x"), F.col("y"), ((1, 0, 0), (0, 1, 0), (0.1, 0, -1)))
    assert [r[0] for r in df.select(x).collect()] == [None] * 4 and df.select(y).first()[0] is None


def test_angle(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 2.0), (1.0, 0.0, -1.0, 0.0), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(F.round(G.angle_degrees(*[F.col(c) for c in "abcd"]), 6)).collect()]
    assert got == [90.0, 180.0, None]


def test_intervals_weigh_means_by_length_and_keep_the_weakest_grades(spark):
    from strideframe.operators.activity import classified_intervals

    names = "analysis_id long, win long, state string, window_seconds double, coverage double, visible int, reliable int, moving int, kitchen int, simultaneous boolean, simultaneous_seconds double, stationary_seconds double, speed double, speed_change double, intensity double, direction_rate double, confidence string, visibility string, continuity string, gap_severity string, reason_codes array<string>"
    rows = [
        (1, 0, "A", 3.0, 1.0, 4, 3, 2, 0, True, 1.0, 0.5, 2.0, 0.0, 0.4, 0.1, "MODERATE", "HIGH", "STRONG", "NONE", ["X", "B"]),
        (1, 1, "A", 1.0, 0.6, 2, 3, 3, 1, False, 0.5, 0.5, 6.0, 4.0, 0.8, 0.3, "LOW", "MODERATE", "POOR", "MINOR", ["A", "B"]),
        (1, 3, "A", 3.0, 1.0, 4, 4, 2, 0, True, 1.0, 0.0, 1.0, 1.0, 0.1, 0.0, "NOT_AVAILABLE", "LOW", "LIMITED", "SEVERE", []),
    ]
    first, second = classified_intervals(spark.createDataFrame(rows, names)).orderBy("first_win").collect()
    assert (first.windows, first.speed, first.speed_change, round(first.intensity, 9), round(first.observed_ratio, 9)) == (2, 3.0, 1.0, 0.5, 0.9)
    assert (first.visible, first.reliable, first.moving, first.kitchen, first.simultaneous, first.simultaneous_seconds) == (2, 3, 2, 1, False, 1.5)
    assert (first.confidence, first.visibility, first.continuity, first.gap_severity, first.reason_codes) == ("LOW", "MODERATE", "POOR", "MINOR", ["A", "B", "X"])
    assert (second.first_win, second.windows, second.confidence) == (3, 1, "NOT_AVAILABLE")
