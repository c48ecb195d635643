"""Geometry as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.policy import Court


def inside(x: Column, y: Column, court: Court, margin: float = 0.0) -> Column:
    return x.between(-margin, court.width + margin) & y.between(-margin, court.length + margin)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def homography(x: Column, y: Column, h: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """The point through a 3x3 matrix; null where the denominator vanishes."""
    a, b, w = [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) for r in h]
    ok = F.abs(w) > 1e-12
    return F.when(ok, a / w), F.when(ok, b / w)


def zone(y: Column, court: Court) -> Column:
    """kitchen, transition or baseline by the distance from the net, bounds belonging to the nearer zone."""
    from_net = F.abs(y - court.net)
    return F.when(from_net <= court.kitchen_depth, "kitchen").when(from_net <= court.kitchen_depth + court.transition_depth, "transition").otherwise("baseline")


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def angle_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The angle between two vectors, 0 to 180; null for a zero vector."""
    norm = F.sqrt(x1 * x1 + y1 * y1) * F.sqrt(x2 * x2 + y2 * y2)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x1 * x2 + y1 * y2) / norm))
    return F.when(norm > 0, F.degrees(F.acos(cosine)))


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
