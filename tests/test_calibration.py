"""Corner checks against plain loops, and homographies against numpy's solver."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import rings as R
from strideframe.operators import calibration as C
from strideframe.plans.policy import Court

RING = "k long, corners array<struct<x:double,y:double>>"
COURT = [(0, 0), (20, 0), (20, 44), (0, 44)]


def cross(a, b, c):
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def crossing(a, b, c, d, touching):
    v = [cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b)]
    if touching:
        s = [0 if abs(x) < 2**-52 else math.copysign(1, x) for x in v]
        return s[0] != s[1] and s[2] != s[3]
    return v[0] * v[1] < 0 and v[2] * v[3] < 0


def self_crossing(p, touching):
    n = len(p)
    return any(crossing(p[i], p[(i + 1) % n], p[j], p[(j + 1) % n], touching) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1))


def problem(p):
    if len(p) != 4:
        return "COUNT"
    if not all(math.isfinite(v) for q in p for v in q):
        return "NOT_FINITE"
    if not all(0 <= x < 10 and 0 <= y < 8 for x, y in p):
        return "OUTSIDE"
    if min(math.dist(a, b) for a, b in itertools.combinations(p, 2)) <= 1e-6:
        return "DUPLICATE"
    if abs(sum(p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4))) / 2 < 2:
        return "SMALL"
    t = [cross(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) for i in range(4)]
    if any(abs(v) <= 1e-6 for v in t):
        return "COLLINEAR"
    if not (all(v > 0 for v in t) or all(v < 0 for v in t)):
        return "NOT_CONVEX"
    return "CROSSING" if self_crossing(p, False) else None


def test_corner_checks_equal_plain_loops_on_random_quadrilaterals(spark):
    rng = random.Random(4)
    rings = [[(float(rng.randint(-1, 10)), float(rng.randint(-1, 8))) for _ in range(rng.choice([4] * 9 + [3, 5]))] for _ in range(1500)]
    rings += [[(1.0, 1.0), (math.nan, 2.0), (3.0, 3.0), (1.0, 4.0)], [(1.0, 1.0), (math.inf, 2.0), (3.0, 3.0), (1.0, 4.0)], []]
    df = spark.createDataFrame(list(enumerate(rings)), RING)
    rule = C.CalibrationPolicy(least_area=2.0)
    got = {r.k: r.p for r in df.select("k", C.corner_problem(F.col("corners"), F.lit(10), F.lit(8), rule).alias("p")).collect()}
    assert got == {k: problem(p) for k, p in enumerate(rings)}
    assert {"COUNT", "NOT_FINITE", "OUTSIDE", "DUPLICATE", "SMALL", "COLLINEAR", "NOT_CONVEX", None} == set(got.values())


@pytest.mark.parametrize("touching", [False, True])
def test_rings_of_any_length(spark, touching):
    rng = random.Random(8)
    rings = [[(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(3, 9))] for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(rings)), RING).select("k", R.self_crossing(F.col("corners"), touching).alias("s"), R.convex(F.col("corners")).alias("c"), R.area(F.col("corners")).alias("a")).collect()
    for r in rows:
        p = rings[r.k]
        n = len(p)
        t = [cross(p[i], p[(i + 1) % n], p[(i + 2) % n]) for i in range(n)]
        area = abs(sum(p[i][0] * p[(i + 1) % n][1] - p[(i + 1) % n][0] * p[i][1] for i in range(n))) / 2
        assert (r.s, r.c, r.a) == (self_crossing(p, touching), all(v > 0 for v in t) or all(v < 0 for v in t), area)


def test_corners_are_put_in_order(spark):
    quads = [list(q) for q in itertools.permutations([(10.0, 90.0), (80.0, 95.0), (70.0, 20.0), (30.0, 25.0)])]
    rows = spark.createDataFrame(list(enumerate(quads)), RING).select(R.corners_in_order(F.col("corners")).alias("o")).collect()
    assert {tuple(map(tuple, r.o)) for r in rows} == {((10.0, 90.0), (80.0, 95.0), (70.0, 20.0), (30.0, 25.0))}


def solved(source, target):
    rows, right = [], []
    for (x, y), (u, v) in zip(np.float32(source).astype(float), np.float32(target).astype(float)):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows), np.array(right)), 1.0]


def test_matrices_equal_numpy_and_map_landmarks_back(spark):
    rng = random.Random(6)
    quads = [[(rng.uniform(50, 300), rng.uniform(500, 700)), (rng.uniform(900, 1200), rng.uniform(500, 700)), (rng.uniform(700, 900), rng.uniform(50, 300)), (rng.uniform(350, 600), rng.uniform(50, 300))] for _ in range(60)]
    quads = [[(round(x * 8) / 8, round(y * 8) / 8) for x, y in q] for q in quads]  # exact in single precision
    quads += [[(0.0, 700.0), (1000.0, 700.0), (1000.0, 0.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(k, q, 1280, 720) for k, q in enumerate(quads)], RING + ", width int, height int")
    rows = C.calibrated(df, Court()).collect()
    good = [r for r in rows if r.problem is None]
    assert len(good) == len(quads) - sum(r.problem is not None for r in rows) and len(good) > 50
    for r in good:
        assert r.image_to_court == pytest.approx(solved(quads[r.k], COURT), rel=1e-6, abs=1e-9)
        assert r.court_to_image == pytest.approx(solved(COURT, quads[r.k]), rel=1e-6, abs=1e-9)
        assert r.round_trip_error <= 1e-6 and r.reprojection_error <= 1e-6


def test_degenerate_maps_are_refused(spark):
    line = [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]
    (row,) = spark.createDataFrame([(1, line)], RING).select(C.homography(F.col("corners"), C.court_corners(Court())).alias("m")).collect()
    assert row.m is None
    flat = spark.createDataFrame([(1, [(3.0, 0.0)])], RING).select(C.mapped(F.col("corners")[0], F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, -3.0)])).alias("p"))
    assert flat.first().p is None
    with pytest.raises(ValueError):
        C.landmarks(spark, Court(), 15.0)
    assert C.landmarks(spark).count() == 7 * 2 + 6 * 4


def test_only_verified_calibrations_project_and_only_their_video_matches(spark):
    corners = [(100.0, 600.0), (1100.0, 600.0), (800.0, 200.0), (400.0, 200.0)]
    df = spark.createDataFrame([(1, corners, 1280, 720, "c1", "s1", ("c1", "s1", "verified")), (2, corners, 1280, 720, "c1", "s2", ("c1", "s1", "verified")), (3, corners, 1280, 720, None, None, None)], RING + ", width int, height int, id string, sum string, v struct<id:string,checksum:string,state:string>")
    rows = C.calibrated(df, Court()).withColumn("projection_state", C.projection_state(F.col("id"), F.col("sum"), F.col("v")))
    rows = C.projected(rows.withColumns({"x": F.lit(100.0), "y": F.lit(600.0), "vw": F.lit(1280), "vh": F.lit(700) + 20 * (F.col("k") % 2)}), "x", "y")
    got = {r.k: (r.projection_state, r.court_x, r.m) for r in rows.select("*", C.matches_video(rows, "vw", "vh").alias("m")).collect()}
    assert got == {1: ("verified", pytest.approx(0, abs=1e-9), True), 2: ("generated_unverified", None, False), 3: ("absent", None, True)}
