"""Queries over calibrations, each with the DuckDB statement that checks it. Customers are calibrations: four corners moved by integers of the key, every kind of fault among them.

Spark solves eight linear equations per row; the statements use the closed form of the map from a rectangle to a quadrilateral.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..session import table
from .policy import Court

COURT = Court()
#: Of a matrix's numbers: what they are shown in, and with how many digits.
_UNIT, _DIGITS = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1000.0, 1000.0, 1.0], [6, 6, 3, 6, 6, 3, 4, 4, 3]
#: For both engines: corners near left, near right, far right, far left.
_CORNERS = """
CAST(CASE WHEN k % 29 = 0 THEN -5 ELSE 100 + k * 7 % 80 END AS DOUBLE) AS x0, CAST(600 + k * 5 % 60 AS DOUBLE) AS y0,
CAST(CASE WHEN k % 31 = 0 THEN 100 + k * 7 % 80 ELSE 1180 - k * 3 % 90 END AS DOUBLE) AS x1, CAST(CASE WHEN k % 31 = 0 THEN 600 + k * 5 % 60 ELSE 620 + k * 11 % 70 END AS DOUBLE) AS y1,
CAST(CASE WHEN k % 37 = 0 THEN 640 + (1180 - k * 3 % 90) - (640) ELSE 900 - k * 13 % 100 END AS DOUBLE) + k % 4 / CAST(4 AS DOUBLE) AS x2, CAST(CASE WHEN k % 41 = 0 THEN 640 ELSE 200 + k * 17 % 50 END AS DOUBLE) AS y2,
CAST(CASE WHEN k % 43 = 0 THEN 700 + k % 7 ELSE 380 + k * 19 % 90 END AS DOUBLE) AS x3, CAST(CASE WHEN k % 43 = 0 THEN 560 ELSE 190 + k * 23 % 70 END AS DOUBLE) AS y3"""


def _calibrations(spark, sf_dir):
    # keys compress to few bytes, so that a file of many calibrations is read in one task: they are dealt out before anything is solved
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = keys.selectExpr("c_custkey", "c_custkey AS k").selectExpr("c_custkey", *[e.strip() for e in _split(_CORNERS)])
    corners = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(4)])
    two = F.col("c_custkey") % 47 == 0
    return rows.select("c_custkey", F.when(two, F.slice(corners, 1, 2)).otherwise(corners).alias("corners"), F.lit(1280).alias("width"), F.lit(720).alias("height"))


def _split(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def corner_checks(spark, sf_dir):
    """The problem of each calibration's corners, and the state that the marking shows for them."""
    rows = _calibrations(spark, sf_dir)
    corners, size = F.col("corners"), (F.when(F.col("c_custkey") % 53 > 0, F.col("width")), F.col("height"))
    return rows.select("c_custkey", C.corner_problem(corners, F.col("width"), F.col("height"), C.CalibrationPolicy()).alias("problem"), C.marking_state(corners, *size, 1.0, 100.0).alias("marking"))


def calibrations(spark, sf_dir):
    """Both matrices of each calibration, and whether the errors are within tolerance."""
    rows = C.calibrated(_calibrations(spark, sf_dir), COURT)
    numbers = [(F.round(F.col(m)[i] * _UNIT[i], _DIGITS[i]) + 0.0).alias(f"{n}{i}") for m, n in (("court_to_image", "c"), ("image_to_court", "i")) for i in range(9)]
    return rows.select("c_custkey", "problem", (F.col("round_trip_error") <= 1e-6).alias("exact"), *numbers)


def landmark_images(spark, sf_dir):
    """Where the court's lines and zones lie in each image."""
    out = C.landmark_images(C.calibrated(_calibrations(spark, sf_dir), COURT), ["c_custkey"], C.landmarks(spark, COURT))
    return out.select("c_custkey", "name", "place", F.round("image_x", 3).alias("image_x"), F.round("image_y", 3).alias("image_y"))


def ball_projection(spark, sf_dir):
    """Orders as places of a ball in their customer's image, on the court where the calibration is verified."""
    rows = C.calibrated(_calibrations(spark, sf_dir), COURT)
    k = F.col("c_custkey")
    ok = rows.where("problem IS NULL").select("c_custkey", "image_to_court")
    known = F.when(k % 11 > 0, k)
    verification = F.struct((k + F.when(k % 7 == 0, 1).otherwise(0)).alias("id"), (k % 5).alias("checksum"), F.when(k % 3 == 0, "rejected").otherwise("verified").alias("state"))
    ok = ok.withColumn("projection_state", C.projection_state(known, F.when(k % 13 == 0, -1).otherwise(k % 5), verification))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 31 % 1280).cast("double").alias("x"), (180 + F.col("o_orderkey") * 17 % 540).cast("double").alias("y"))
    out = C.projected(orders.join(ok, F.col("o_custkey") == k), "x", "y")
    return out.select("o_orderkey", "projection_state", F.round("court_x", 3).alias("court_x"), F.round("court_y", 3).alias("court_y"))


_CALIBRATIONS = f"""
q0 AS (SELECT c_custkey AS k, {_CORNERS} FROM customer),
q1 AS (SELECT *, k % 47 = 0 AS two, 0.5::DOUBLE * abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) AS area,
    (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) AS t1, (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) AS t2, (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3) AS t3, (x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0) AS t4,
    least(sqrt((x0-x1)^2+(y0-y1)^2), sqrt((x0-x2)^2+(y0-y2)^2), sqrt((x0-x3)^2+(y0-y3)^2), sqrt((x1-x2)^2+(y1-y2)^2), sqrt((x1-x3)^2+(y1-y3)^2), sqrt((x2-x3)^2+(y2-y3)^2)) AS near,
    least(x0, x1, x2, x3) < 0 OR greatest(x0, x1, x2, x3) >= 1280 OR least(y0, y1, y2, y3) < 0 OR greatest(y0, y1, y2, y3) >= 720 AS out_all, least(x0, x1) < 0 OR greatest(x0, x1) >= 1280 AS out_two,
    x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy, x1 - x2 AS dx1, x3 - x2 AS dx2, y1 - y2 AS dy1, y3 - y2 AS dy2 FROM q0),
q2 AS (SELECT *, t1 > 0 AND t2 > 0 AND t3 > 0 AND t4 > 0 OR t1 < 0 AND t2 < 0 AND t3 < 0 AND t4 < 0 AS convex,
    CASE WHEN two THEN 'COUNT' WHEN out_all THEN 'OUTSIDE' WHEN near <= 1e-6::DOUBLE THEN 'DUPLICATE' WHEN area < 100 THEN 'SMALL' WHEN least(abs(t1), abs(t2), abs(t3), abs(t4)) <= 1e-6::DOUBLE THEN 'COLLINEAR'
      WHEN NOT (t1 > 0 AND t2 > 0 AND t3 > 0 AND t4 > 0 OR t1 < 0 AND t2 < 0 AND t3 < 0 AND t4 < 0) THEN 'NOT_CONVEX' END AS problem,
    dx1 * dy2 - dx2 * dy1 AS de FROM q1),
q3 AS (SELECT *, (sx * dy2 - dx2 * sy) / de AS g, (dx1 * sy - sx * dy1) / de AS h FROM q2 WHERE problem IS NULL),
q4 AS (SELECT k, (x1 - x0 + g * x1) / 20 AS c0, (x3 - x0 + h * x3) / 44 AS c1, x0 AS c2, (y1 - y0 + g * y1) / 20 AS c3, (y3 - y0 + h * y3) / 44 AS c4, y0 AS c5, g / 20 AS c6, h / 44 AS c7, 1::DOUBLE AS c8 FROM q3),
q5 AS (SELECT *, c0 * c4 - c1 * c3 AS w, c4 * c8 - c5 * c7 AS a0, c2 * c7 - c1 * c8 AS a1, c1 * c5 - c2 * c4 AS a2, c5 * c6 - c3 * c8 AS a3, c0 * c8 - c2 * c6 AS a4, c2 * c3 - c0 * c5 AS a5, c3 * c7 - c4 * c6 AS a6, c1 * c6 - c0 * c7 AS a7 FROM q4)"""

CORNER_SQL = f"""
WITH {_CALIBRATIONS}
SELECT k AS c_custkey, problem, CASE WHEN k % 53 = 0 THEN 'WAITING' WHEN two THEN 'INCOMPLETE' WHEN out_all THEN 'OUTSIDE' WHEN near <= 1 THEN 'DUPLICATE' WHEN area < 100 THEN 'SMALL' WHEN NOT convex THEN 'NO_POLYGON' ELSE 'VALID' END AS marking FROM q2
"""
CALIBRATIONS_SQL = f"""
WITH {_CALIBRATIONS}
SELECT q2.k AS c_custkey, problem, CASE WHEN problem IS NULL THEN true END AS exact, {", ".join(f"round(c{i} * {_UNIT[i]}, {_DIGITS[i]}) + 0 AS c{i}" for i in range(9))},
  {", ".join(f"round(a{i} / w * {_UNIT[i]}, {_DIGITS[i]}) + 0 AS i{i}" for i in range(8))}, CASE WHEN w IS NOT NULL THEN 1::DOUBLE END AS i8
FROM q2 LEFT JOIN q5 USING (k)
"""
_ACROSS = {"near_baseline": (0, 0), "far_baseline": (44, 44), "net_line": (22, 22), "near_kitchen_line": (15, 15), "far_kitchen_line": (29, 29)}
_DEEP = {"near_non_volley_zone": (15, 22), "far_non_volley_zone": (22, 29), "near_transition_area": (7, 15), "far_transition_area": (29, 37), "near_baseline_area": (0, 7), "far_baseline_area": (37, 44)}
_MARKS = (
    [(n, i, x, y) for n, ys in _ACROSS.items() for i, (x, y) in enumerate(((0, ys[0]), (20, ys[1])))]
    + [("near_center_service_line", 0, 10, 0), ("near_center_service_line", 1, 10, 15), ("far_center_service_line", 0, 10, 29), ("far_center_service_line", 1, 10, 44)]
    + [(n, i, x, y) for n, (a, b) in _DEEP.items() for i, (x, y) in enumerate(((0, a), (20, a), (20, b), (0, b)))]
)
LANDMARKS_SQL = f"""
WITH {_CALIBRATIONS}, m AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {i}, {x}::DOUBLE, {y}::DOUBLE)" for n, i, x, y in _MARKS)}) AS v(name, place, x, y))
SELECT k AS c_custkey, name, place, round((c0 * x + c1 * y + c2) / (c6 * x + c7 * y + 1), 3) AS image_x, round((c3 * x + c4 * y + c5) / (c6 * x + c7 * y + 1), 3) AS image_y FROM q4, m
"""
PROJECTION_SQL = f"""
WITH {_CALIBRATIONS},
v AS (SELECT o_orderkey, CASE WHEN k % 11 = 0 THEN 'absent' WHEN k % 7 > 0 AND k % 13 > 0 AND k % 3 > 0 THEN 'verified' ELSE 'generated_unverified' END AS projection_state,
    (o_orderkey * 31 % 1280)::DOUBLE AS x, (180 + o_orderkey * 17 % 540)::DOUBLE AS y, q5.* FROM orders JOIN q5 ON q5.k = o_custkey),
p AS (SELECT *, a6 * x + a7 * y + w AS d FROM v)
SELECT o_orderkey, projection_state, CASE WHEN projection_state = 'verified' THEN round((a0 * x + a1 * y + a2) / d, 3) END AS court_x, CASE WHEN projection_state = 'verified' THEN round((a3 * x + a4 * y + a5) / d, 3) END AS court_y FROM p
"""

QUERIES = {f.__name__: f for f in (corner_checks, calibrations, landmark_images, ball_projection)}
ORACLES = {"corner_checks": CORNER_SQL, "calibrations": CALIBRATIONS_SQL, "landmark_images": LANDMARKS_SQL, "ball_projection": PROJECTION_SQL}
