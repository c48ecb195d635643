"""Small scalar functions as column expressions: boxes, polygons, names, identifiers and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def ground_point(x1: Column, x2: Column, y2: Column) -> Point:
    """The middle of a box's lower edge."""
    return (x1 + x2) / 2, y2


def cross(a: Point, b: Point, p: Point) -> Column:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def segments_cross(a: Point, b: Point, p: Point, q: Point) -> Column:
    """Whether two segments meet inside both: each has its ends on strictly different sides of the other."""
    return (cross(a, b, p) * cross(a, b, q) < 0) & (cross(p, q, a) * cross(p, q, b) < 0)


def segments_touch(a: Point, b: Point, p: Point, q: Point) -> Column:
    """As segments_cross(), by the signs of the turns: an end on the other's line counts."""
    return (F.signum(cross(a, b, p)) != F.signum(cross(a, b, q))) & (F.signum(cross(p, q, a)) != F.signum(cross(p, q, b)))


def polygon_area(points: list[Point]) -> Column:
    turns = [a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])]
    total = turns[0]
    for t in turns[1:]:
        total = total + t
    return F.abs(total) / 2


def court_pixel(x: Column, y: Column, width: int, height: int, margin: int, court: tuple[float, float]) -> Point:
    """Court feet as pixels of a picture with a margin, y upwards; halves go to the even number."""
    return F.bround(margin + x / court[0] * (width - 2 * margin)), F.bround(height - margin - y / court[1] * (height - 2 * margin))


def weighted_mean(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    return F.coalesce(F.try_divide(a * wa + b * wb, wa + wb), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def least_over_most(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) <= 0, 0.0).otherwise(F.try_divide(F.least(a, b), F.greatest(a, b)))


def court_score(area_share: Column, solidity: Column, balance: Column) -> Column:
    return 0.20 + 0.55 * clamp(area_share) + 0.15 * clamp(solidity) + 0.10 * clamp(balance)


def ball_confidence(circularity: Column, color: Column, motion: Column, size: Column) -> Column:
    return 0.30 * circularity + 0.25 * color + 0.30 * motion + 0.15 * size


def mean_point_error(actual: list[Point], expected: list[Point]) -> Column:
    steps = [F.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(actual, expected)]
    return sum(steps[1:], steps[0]) / len(steps)


def artifact_kind(key: Column, kinds: dict[str, str]) -> Column:
    """Kind by the first folder of a storage key; other folders are OTHER."""
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.element_at(table, F.get(F.split(key, "/"), F.lit(0))), F.lit("OTHER"))


def name_version(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"\.v([1-9][0-9]*)\.", 1), F.lit("")).cast("long")


def title(name: Column, fallback: Column) -> Column:
    """A file's stem with spaces for _ and -, or the first eight characters of an id."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[_-]", " "))
    return F.when(stem == "", F.substring(fallback, 1, 8)).otherwise(stem)


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")


def structured_reason(text: Column, allowed: list[str], default: str) -> Column:
    code = F.translate(F.lower(F.trim(text)), " ", "_")
    return F.when(code.isin(allowed), code).otherwise(default)


def attempt_prefix(stage: Column, attempt: Column) -> Column:
    return F.concat(F.lower(stage), F.lit("/attempt-"), F.lpad(attempt.cast("string"), F.greatest(F.length(attempt.cast("string")), F.lit(4)), F.lit("0")))


def short_id(value: Column) -> Column:
    return F.when(F.length(value) > 12, F.concat(F.substring(value, 1, 8), F.lit("..."), F.right(value, F.lit(4)))).otherwise(value)


def duration_text(seconds: Column) -> Column:
    """Rounded seconds, never below 0, with minutes from one on."""
    whole = F.greatest(F.floor(seconds + 0.5).cast("long"), F.lit(0))
    return F.when(whole >= 60, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%ds", whole))


def distance_text(feet: Column) -> Column:
    return F.when(_is_number(feet), F.format_string("%.1f ft", feet)).otherwise("Unavailable")


def tracked_time_text(seconds: Column) -> Column:
    return F.when(~_is_number(seconds), "Unavailable").when(seconds < 60, F.format_string("%.1f sec", seconds)).otherwise(F.format_string("%.1f min", seconds / 60))


def _is_number(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def frame_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"frame_(\d{6})\.jpg$", 1), F.lit("")).cast("long")


def size_text(size: Column) -> Column:
    """Bytes (an integer or a decimal without digits behind the point) as they are, KB and MB with one decimal, GB with two."""
    rounded = lambda n, tens: F.round(size.cast("double") / F.lit(float(n)) * tens) / tens
    part = lambda n, text: F.format_string(text, rounded(n, 100.0 if "2" in text else 10.0))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, part(1024, "%.1f KB")).when(size < 1024**3, part(1024**2, "%.1f MB")).otherwise(part(1024**3, "%.2f GB"))


def change_label(direction: Column, change: Column, unit: Column) -> Column:
    """What a metric has done, by its direction (HIGHER, LOWER or STABLE) and change."""
    amount = F.concat(F.format_string("%.1f", F.abs(change)), F.when(unit == "%", "%").otherwise(F.concat(F.lit(" "), unit)))
    moved = F.concat(F.when(direction == "HIGHER", "Increased by ").otherwise("Decreased by "), amount)
    return F.when(direction.isNull() | change.isNull(), "Unavailable").when(direction == "STABLE", "Remained similar").otherwise(moved)


def capacity_state(free: Column, asked: Column, warning: int, stop: int) -> Column:
    left = free - asked
    return F.when(left < stop, "hard_stop").when(left < warning, "warning").otherwise("available")
