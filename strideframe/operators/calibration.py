"""Court calibration, one row each: checks of the marked corners, the homographies both ways, their errors, and what may be projected with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rings as R
from ..plans.policy import Court

_TINY = 1e-12
POINTS = "array<struct<x:double,y:double>>"


@dataclass(frozen=True)
class CalibrationPolicy:
    tolerance: float = 1e-6
    least_area: float = 100.0

    def __post_init__(self):
        if self.tolerance <= 0 or self.least_area <= 0:
            raise ValueError("tolerance and least area must be positive")


def points(*pairs: tuple[float, float]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pairs])


def court_corners(court: Court) -> Column:
    return points((0, 0), (court.width, 0), (court.width, court.length), (0, court.length))


def corner_problem(corners: Column, width: Column, height: Column, rule: CalibrationPolicy) -> Column:
    """The first reason why four marked corners are no court, null if there is none: COUNT, NOT_FINITE, OUTSIDE, DUPLICATE, SMALL, COLLINEAR, NOT_CONVEX, CROSSING."""
    finite = F.forall(corners, lambda p: _finite(p["x"]) & _finite(p["y"]))
    inside = F.forall(corners, lambda p: (p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] < height))
    straight = F.exists(R.turns(corners), lambda t: F.abs(t) <= rule.tolerance)
    return (
        F.when(F.coalesce(F.size(corners), F.lit(0)) != 4, "COUNT")
        .when(~F.coalesce(finite, F.lit(False)), "NOT_FINITE")
        .when(~inside, "OUTSIDE")
        .when(R.closest(corners) <= rule.tolerance, "DUPLICATE")
        .when(R.area(corners) < rule.least_area, "SMALL")
        .when(straight, "COLLINEAR")
        .when(~R.convex(corners), "NOT_CONVEX")
        .when(R.self_crossing(corners), "CROSSING")
    )


def marking_state(corners: Column, width: Column, height: Column, distinct: float, least_area: float) -> Column:
    """The same for corners as they are being marked in any order: WAITING, INCOMPLETE, OUTSIDE, DUPLICATE, SMALL, NO_POLYGON, VALID."""
    inside = F.forall(corners, lambda p: (p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] < height))
    return (
        F.when(width.isNull() | height.isNull(), "WAITING")
        .when(F.size(corners) < 4, "INCOMPLETE")
        .when(~inside, "OUTSIDE")
        .when(R.closest(corners) <= distinct, "DUPLICATE")
        .when(R.area(corners) < least_area, "SMALL")
        .when(R.self_crossing(corners, touching=True) | ~R.convex(corners), "NO_POLYGON")
        .otherwise("VALID")
    )


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def solved(system: Column, n: int) -> Column:
    """The solution of n linear equations, an array of n rows of n + 1 numbers, by elimination with row pivots; null entries where there is none."""

    def reduced(rows, k):
        left = F.sequence(k, F.lit(n - 1))
        best = -F.array_max(F.transform(left, lambda i: F.struct(F.abs(rows[i][k]).alias("v"), (-i).alias("i"))))["i"]
        swapped = R.let(best, lambda p: F.transform(rows, lambda row, i: F.when(i == k, rows[p]).when(i == p, rows[k]).otherwise(row)))

        def eliminated(held):
            pivot = F.transform(held[k], lambda v: F.try_divide(v, held[k][k]))
            return R.let(pivot, lambda top: F.transform(held, lambda row, i: F.when(i == k, top).otherwise(F.zip_with(row, top, lambda v, t: v - row[k] * t))))

        return R.let(swapped, eliminated)

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), system, reduced), lambda row: row[n])


def homography(source: Column, target: Column) -> Column:
    """Nine numbers, row by row, of the perspective map that takes four points to four others; null without one that is finite and regular.

    Coordinates are taken in single precision, as image libraries take them, and solved in double precision.
    """
    single = lambda v: v.cast("float").cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)

    def equations(p):
        x, y, u, v = (single(p[s][c]) for s, c in (("s", "x"), ("s", "y"), ("t", "x"), ("t", "y")))
        return F.array(F.array(x, y, one, zero, zero, zero, -x * u, -y * u, u), F.array(zero, zero, zero, x, y, one, -x * v, -y * v, v))

    system = F.flatten(F.transform(F.arrays_zip(source.alias("s"), target.alias("t")), equations))
    return R.let(F.concat(solved(system, 8), F.array(one)), lambda m: F.when(F.forall(m, _finite) & (F.abs(determinant(m)) > _TINY), m))


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def mapped(point: Column, m: Column) -> Column:
    """The point through the matrix; null where the denominator vanishes or a coordinate is not finite."""

    def divided(h):
        return F.struct(F.try_divide(h["u"], h["w"]).alias("x"), F.try_divide(h["v"], h["w"]).alias("y"), (F.abs(h["w"]) > _TINY).alias("ok"))

    def through(p):
        return F.struct(*[(m[3 * i] * p["x"] + m[3 * i + 1] * p["y"] + m[3 * i + 2]).alias(n) for i, n in enumerate("uvw")])

    kept = lambda q: F.when(q["ok"] & _finite(q["x"]) & _finite(q["y"]), F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return R.let(R.let(R.let(point, through), divided), kept)


def reprojection_error(source: Column, target: Column, m: Column) -> Column:
    """The mean distance of the mapped points from where they belong."""
    off = F.transform(F.arrays_zip(source.alias("s"), target.alias("t")), lambda p: R.let(mapped(p["s"], m), lambda q: F.hypot(q["x"] - p["t"]["x"], q["y"] - p["t"]["y"])))
    return F.aggregate(off, F.lit(0.0), lambda a, b: a + b) / F.size(off)


def round_trip_error(there: Column, back: Column, landmarks: Column) -> Column:
    """The largest distance of a landmark from itself after a way there and back; null if one is lost."""
    off = F.transform(landmarks, lambda p: R.let(mapped(mapped(p, there), back), lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))
    return F.when(F.forall(off, lambda v: v.isNotNull()), F.array_max(off))


def calibrated(df: DataFrame, court: Court, rule: CalibrationPolicy = CalibrationPolicy()) -> DataFrame:
    """Adds problem, image_to_court, court_to_image, reprojection_error and round_trip_error to rows with corners, width and height.

    After the corners' own problems come SINGULAR (no regular matrix) and INACCURATE (an error over the tolerance). Rows with a problem have no matrices.
    The equations of a batch of rows are solved together, and once: filters on what comes out stay behind.
    """
    rows = df.select(*df.columns, F.inline(F.array(R.let(F.struct("corners", "width", "height"), lambda s: F.struct(corner_problem(s["corners"], s["width"], s["height"], rule).alias("__problem"))))))
    places = [F.when(F.col("__problem").isNull(), F.col("corners")[i][c]) for i in range(4) for c in "xy"]
    solved_rows = rows.withColumn("__s", _solving(court)(*places))
    part = lambda c: F.col(f"__s.{c}")
    exact = F.coalesce((part("reprojection") <= rule.tolerance) & (part("round_trip") <= rule.tolerance), F.lit(False))
    problem = F.coalesce("__problem", F.when(part("back").isNull() | part("there").isNull(), "SINGULAR").when(~exact, "INACCURATE"))
    fine = exact & F.col("__problem").isNull()
    return solved_rows.select(
        *df.columns, problem.alias("problem"), F.when(fine, part("back")).alias("image_to_court"), F.when(fine, part("there")).alias("court_to_image"),
        part("reprojection").alias("reprojection_error"), part("round_trip").alias("round_trip_error"),
    )


def _eliminated(rows: np.ndarray) -> np.ndarray:
    """`solved` for many systems at once, (systems, n, n + 1) numbers, by the same steps; not finite where there is no solution."""
    every = np.arange(len(rows))
    for k in range(rows.shape[1]):
        best = k + np.abs(rows[:, k:, k]).argmax(axis=1)
        pivot = rows[every, best]
        rows[every, best] = rows[:, k]
        rows[:, k] = pivot / pivot[:, k, None]
        for i in range(rows.shape[1]):
            if i != k:
                rows[:, i] -= rows[:, i, k, None] * rows[:, k]
    return rows[:, :, -1]


def _homographies(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """`homography` for many pairs of four points, (rows, 4, 2); not a number where there is none."""
    (x, y), (u, v) = (np.moveaxis(p.astype(np.float32).astype(float), 2, 0) for p in (source, target))
    one, zero = np.ones_like(x), np.zeros_like(x)
    own = np.stack([np.stack([x, y, one, zero, zero, zero, -x * u, -y * u, u], 2), np.stack([zero, zero, zero, x, y, one, -x * v, -y * v, v], 2)], 2)
    m = np.concatenate([_eliminated(own.reshape(len(x), 8, 9)), np.ones((len(x), 1))], 1)
    det = m[:, 0] * (m[:, 4] * m[:, 8] - m[:, 5] * m[:, 7]) - m[:, 1] * (m[:, 3] * m[:, 8] - m[:, 5] * m[:, 6]) + m[:, 2] * (m[:, 3] * m[:, 7] - m[:, 4] * m[:, 6])
    return np.where((np.isfinite(m).all(axis=1) & (np.abs(det) > _TINY))[:, None], m, np.nan)


def _images(points: np.ndarray, m: np.ndarray) -> np.ndarray:
    """`mapped` for (rows, points, 2) and one matrix a row; not a number where a point has no image."""
    u, v, w = (m[:, i, None] * points[:, :, 0] + m[:, i + 1, None] * points[:, :, 1] + m[:, i + 2, None] for i in (0, 3, 6))
    out = np.stack([u / w, v / w], 2)
    return np.where(((np.abs(w) > _TINY) & np.isfinite(out).all(axis=2))[:, :, None], out, np.nan)


def _solving(court: Court):
    """A function of the four corners' coordinates: both matrices, the mean reprojection error and the largest round-trip error, a batch of rows at a time."""
    middle, kitchen = court.width / 2, court.kitchen_depth
    corners_of_court = np.array([(0, 0), (court.width, 0), (court.width, court.length), (0, court.length)], float)
    landmarks = np.concatenate([corners_of_court, [(middle, court.net), (middle, court.net - kitchen), (middle, court.net + kitchen)]])

    def matrices(m):
        return [None if np.isnan(row[0]) else row for row in m]

    def solve(*places: pd.Series) -> pd.DataFrame:
        corners = np.stack([p.to_numpy(float) for p in places], 1).reshape(-1, 4, 2)
        goal, marks = (np.broadcast_to(p, (len(corners), *p.shape)) for p in (corners_of_court, landmarks))
        with np.errstate(all="ignore"):
            back, there = _homographies(corners, goal), _homographies(goal, corners)
            off = _images(corners, back) - goal
            trip = _images(_images(marks, there), back) - marks
            reprojection, round_trip = np.hypot(off[:, :, 0], off[:, :, 1]).mean(axis=1), np.hypot(trip[:, :, 0], trip[:, :, 1]).max(axis=1)
        return pd.DataFrame({"back": matrices(back), "there": matrices(there), "reprojection": reprojection, "round_trip": round_trip})

    return F.pandas_udf(solve, "back array<double>, there array<double>, reprojection double, round_trip double")


def projection_state(calibration: Column, checksum: Column, verification: Column) -> Column:
    """absent without a calibration id; verified where the verification (struct of id, checksum, state) is about this calibration and file; else generated_unverified."""
    same = (verification["id"] == calibration) & (verification["checksum"] == checksum) & (verification["state"] == "verified")
    return F.when(calibration.isNull(), "absent").when(F.coalesce(same, F.lit(False)), "verified").otherwise("generated_unverified")


def projected(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Adds court_x and court_y to rows with image_to_court and projection_state; what is not verified or has no image on the court stays unprojected."""
    point = mapped(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.col("image_to_court"))
    point = F.when(F.col("projection_state") == "verified", point)
    return rows.withColumns({"court_x": point["x"], "court_y": point["y"]})


def matches_video(rows: DataFrame, width: str, height: str) -> Column:
    """Whether a calibration is for a video's size and can map the first corner."""
    return (F.col("width") == F.col(width)) & (F.col("height") == F.col(height)) & mapped(F.col("corners")[0], F.col("image_to_court")).isNotNull()


def landmarks(spark: SparkSession, court: Court = Court(), transition: float | None = None) -> DataFrame:
    """Lines and zones of the court as polygons: name, kind, place, x, y."""
    depth = court.transition_depth if transition is None else transition
    near, far, middle = court.net - court.kitchen_depth, court.net + court.kitchen_depth, court.width / 2
    if depth <= 0 or near - depth <= 0 or far + depth >= court.length:
        raise ValueError("the transition area must fit between baseline and kitchen line")
    across = lambda y: [(0.0, y), (court.width, y)]
    lines = {
        "near_baseline": across(0.0), "far_baseline": across(court.length), "net_line": across(court.net), "near_kitchen_line": across(near), "far_kitchen_line": across(far),
        "near_center_service_line": [(middle, 0.0), (middle, near)], "far_center_service_line": [(middle, far), (middle, court.length)],
    }
    zones = {
        "near_non_volley_zone": (near, court.net), "far_non_volley_zone": (court.net, far), "near_transition_area": (near - depth, near),
        "far_transition_area": (far, far + depth), "near_baseline_area": (0.0, near - depth), "far_baseline_area": (far + depth, court.length),
    }
    polygons = {name: across(low) + across(high)[::-1] for name, (low, high) in zones.items()}
    rows = [(name, kind, place, float(x), float(y)) for kind, held in (("line", lines), ("zone", polygons)) for name, ends in held.items() for place, (x, y) in enumerate(ends)]
    return spark.createDataFrame(rows, "name string, kind string, place int, x double, y double")


def landmark_images(calibrations: DataFrame, keys: Sequence[str], marks: DataFrame) -> DataFrame:
    """Every landmark point of every calibration in its image, 38 rows per calibration."""
    marks = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["place"]).alias("place"), F.lit(r["x"]).alias("x"), F.lit(r["y"]).alias("y")) for r in marks.collect()])
    rows = calibrations.where("court_to_image IS NOT NULL").select(*keys, "court_to_image", F.explode(marks).alias("m"))
    image = mapped(F.col("m"), F.col("court_to_image"))
    return rows.select(*keys, "m.name", "m.place", image["x"].alias("image_x"), image["y"].alias("image_y"))
