"""Checks of closed polygons, arrays of (x, y) structs of any length, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _turned(points: Column, by: int) -> Column:
    """The points from number `by` on, the first ones last."""
    return F.concat(F.slice(points, by + 1, F.greatest(F.size(points) - by, F.lit(0))), F.slice(points, 1, by))


def cross(a: Column, b: Column, c: Column) -> Column:
    """The turn at b on the way from a to c: positive to one side, negative to the other, 0 straight on."""
    return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])


def turns(points: Column) -> Column:
    """The cross products at all corners, the second point's first."""
    triples = F.arrays_zip(points.alias("a"), _turned(points, 1).alias("b"), _turned(points, 2).alias("c"))
    return F.transform(triples, lambda t: cross(t["a"], t["b"], t["c"]))


def area(points: Column) -> Column:
    """The area by the shoelace formula."""
    pairs = F.arrays_zip(points.alias("a"), _turned(points, 1).alias("b"))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))) / 2


def crosses(a: Column, b: Column, c: Column, d: Column, touching: bool = False) -> Column:
    """Whether the segments a-b and c-d cross. Without `touching` both must have the other's ends on different sides; with it a straight turn is a
    third side, so that a segment that ends on the other counts."""
    first, second, third, fourth = cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b)
    if touching:
        side = lambda v: F.when(F.abs(v) < 2.0**-52, 0).otherwise(F.when(v > 0, 1).otherwise(-1))
        return (side(first) != side(second)) & (side(third) != side(fourth))
    return (first * second < 0) & (third * fourth < 0)


def self_crossing(points: Column, touching: bool = False) -> Column:
    """Whether two edges that share no corner cross."""
    edges = F.transform(F.arrays_zip(points.alias("a"), _turned(points, 1).alias("b")), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))
    n = F.size(points)

    def meets(e):
        return F.exists(edges, lambda o: (o["i"] > e["i"] + 1) & ~((e["i"] == 0) & (o["i"] == n - 1)) & crosses(e["a"], e["b"], o["a"], o["b"], touching))

    return F.exists(edges, meets)


def convex(points: Column) -> Column:
    """Whether all turns go to the same side and none is straight."""
    return let(turns(points), lambda t: F.forall(t, lambda v: v > 0) | F.forall(t, lambda v: v < 0))


def closest(points: Column) -> Column:
    """The least distance of two points; null for fewer."""
    marked = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i")))
    pairs = F.flatten(F.transform(marked, lambda p: F.transform(F.filter(marked, lambda o: o["i"] > p["i"]), lambda o: F.hypot(p["x"] - o["x"], p["y"] - o["y"]))))
    return F.array_min(pairs)


def corners_in_order(points: Column) -> Column:
    """Four points as near left, near right, far right, far left: the two with the smallest y are far; equals keep their order."""
    marked = F.transform(points, lambda p, i: F.struct(p["y"].alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))

    def by_x(side):
        return F.array_sort(F.transform(side, lambda p, i: F.struct(p["x"].alias("k"), i.alias("i"), p["y"].alias("y"))))

    def placed(rows):
        far, near = by_x(F.slice(rows, 1, 2)), by_x(F.slice(rows, 3, 2))
        return F.transform(F.array(near[0], near[1], far[1], far[0]), lambda p: F.struct(p["k"].alias("x"), p["y"].alias("y")))

    return let(F.array_sort(marked), placed)
