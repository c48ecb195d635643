"""Ball path reconstruction: a fold over frames in independent stretches, its events and counters, and reports on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import BallPolicy
from .windows import running, with_previous

#: Frames of a player whose order one task looks at.
BLOCK = 4096
TRACK = (
    "kind string, analysis_id long, stretch long, segment long, frame long, x double, y double, confidence double, interpolated boolean, "
    "distance double, gap long, event string, detail string"
)
_COLUMNS = [c.split()[0] for c in TRACK.split(", ")]


def stretches(frames: DataFrame, rule: BallPolicy) -> DataFrame:
    """Adds `stretch` and `last_stretch` to the frames from the first detection on.

    A detection after more than `restart` frames without one starts a new segment whatever came before, so a stretch, named by its first
    frame, is folded without the others. Frames are numbered without holes. Blocks of frames are looked at separately and get what
    the blocks before them know, so a player of many frames is spread over many tasks.
    """
    seen = F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.col("frame"))
    rows = running(frames.withColumn("__seen", seen), ["analysis_id"], "frame", BLOCK, "__seen", F.max, "__last")
    starts = F.when(F.col("__seen").isNotNull() & (F.col("__last").isNull() | (F.col("frame") - F.col("__last") - 1 > rule.restart)), F.col("frame"))
    rows = running(rows.withColumn("__start", starts), ["analysis_id"], "frame", BLOCK, "__start", F.max, "__before")
    rows = rows.withColumn("stretch", F.coalesce("__start", "__before")).where("stretch IS NOT NULL")
    last = rows.groupBy("analysis_id").agg(F.max("stretch").alias("__most"))
    return rows.join(last, "analysis_id").withColumn("last_stretch", F.col("stretch") == F.col("__most")).drop("__seen", "__last", "__start", "__before", "__most")


class _Path:
    """The state of one stretch; rows of TRACK without kind, segments counted from 1."""

    def __init__(self, key: tuple[int, int], rule: BallPolicy):
        self.key, self.rule, self.rows = key, rule, []
        self.last = self.before = None
        self.gap, self.segment = 0, 0

    def event(self, event: str, frame: int, gap: int | None = None, detail: str | None = None) -> None:
        self.rows.append(("event", *self.key, self.segment, frame, None, None, None, None, None, gap, event, detail))

    def point(self, frame, x, y, confidence, interpolated=False, distance=None, gap=0) -> None:
        self.rows.append(("point", *self.key, self.segment, frame, x, y, confidence, interpolated, distance, gap, None, None))

    def limit(self) -> float:
        reach = self.rule.base + self.gap * self.rule.per_gap
        if self.before is not None:
            reach = max(reach, _distance(self.last, self.before) * (self.gap + 1) * self.rule.velocity_factor)
        return reach

    def take(self, frame: int, x: float | None, y: float | None, confidence: float) -> None:
        if x is None or math.isnan(x):
            self.gap += 1
            if self.gap == 1:
                self.event("gap_started", frame)
            return
        here = (frame, x, y, confidence)
        if self.last is None or self.gap > self.rule.restart:
            if self.last is not None:
                self.event("segment_ended", self.last[0], self.gap, "association_gap_exceeded")
            self.segment += 1
            self.event("segment_started", frame)
            self.point(*here)
            self.before = None
        else:
            distance = _distance(here, self.last)
            if distance > self.limit():
                self.event("impossible_motion", frame)
                self.gap += 1
                return
            if self.gap:
                short = self.gap <= self.rule.interpolate
                for k in range(1, self.gap + 1 if short else 1):
                    part = k / (self.gap + 1)
                    x0, y0 = self.last[1:3]
                    self.point(self.last[0] + k, x0 + part * (x - x0), y0 + part * (y - y0), min(self.last[3], confidence) * self.rule.interpolated_confidence, True, None, self.gap)
                self.event("reacquired", frame, self.gap, "short_gap_interpolated" if short else "long_gap_not_interpolated")
            self.point(*here, distance=distance)
            self.before = self.last
        self.last, self.gap = here, 0

    def end(self, last_stretch: bool) -> None:
        self.event("segment_ended", self.last[0], self.gap, "stream_ended" if last_stretch else "association_gap_exceeded")


def _distance(a: tuple, b: tuple) -> float:
    return math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))


def track(frames: DataFrame, rule: BallPolicy) -> DataFrame:
    """TRACK rows of `frames` (analysis_id, frame, x, y, confidence): points on the path, and events, rejected motion included. Segments count from 1 within an analysis.

    A task reads its stretches as one sorted stream and keeps the state of one at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, ends = None, False
        for pdf in batches:
            rows = []
            for analysis, stretch, frame, x, y, confidence, last in pdf.itertuples(index=False):
                if path is None or path.key != (analysis, stretch):
                    if path is not None:
                        path.end(ends)
                        rows += path.rows
                    path, ends = _Path((analysis, stretch), rule), last
                path.take(frame, x, y, confidence)
            if path is not None:
                rows += path.rows
                path.rows = []
            yield _frame(rows)
        if path is not None:
            path.end(ends)
            yield _frame(path.rows)

    keys = ["analysis_id", "stretch"]
    rows = stretches(frames, rule).select(*keys, "frame", "x", "y", "confidence", "last_stretch")
    local = rows.repartition(*keys).sortWithinPartitions(*keys, "frame").mapInPandas(fold, TRACK)
    counts = local.where("event = 'segment_started'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    offsets = running(counts, ["analysis_id"], "stretch", 64 * BLOCK, "n", F.sum, "offset").select(*keys, F.coalesce("offset", F.lit(0)).alias("offset"))
    return local.join(offsets, keys).withColumn("segment", F.col("segment") + F.col("offset")).select(*_COLUMNS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({"gap": "Int64", "interpolated": "boolean"})


def reconstruct(frames: DataFrame, rule: BallPolicy) -> DataFrame:
    """The points of track()."""
    return track(frames, rule).where("kind = 'point'").select("analysis_id", "frame", "x", "y", "segment", "interpolated", "confidence", "gap", "distance")


def events(frames: DataFrame, rule: BallPolicy) -> DataFrame:
    """The log of track(): starts, gaps, reacquisitions and ends."""
    return track(frames, rule).where("kind = 'event' AND event <> 'impossible_motion'").select("analysis_id", "frame", "event", "segment", "gap", "detail")


def segments(path: DataFrame, rule: BallPolicy) -> DataFrame:
    """Per segment its frames, points, mean confidence, and whether it is too short to stand alone."""
    out = path.groupBy("analysis_id", "segment").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("points"), F.count_if(~F.col("interpolated")).alias("observed"), F.avg("confidence").alias("mean_confidence")
    )
    return out.withColumn("fragment", F.col("observed") < rule.min_segment)


def report(frames: DataFrame, rule: BallPolicy) -> DataFrame:
    """Per analysis: coverage of detections and of the path, counters, percentiles of the accepted confidences, gaps, fragmentation, and the status of the evidence."""
    rows = track(frames, rule)
    point, event = F.col("kind") == "point", F.col("event")
    observed, gap = point & ~F.col("interpolated"), F.when(event.isin("reacquired", "segment_ended") & (F.col("gap") > 0), F.col("gap"))
    found = rows.groupBy("analysis_id").agg(
        F.count_if(observed).alias("observed"),
        F.count_if(point & F.col("interpolated")).alias("interpolated"),
        F.count_if(event == "segment_started").alias("segments"),
        F.count_if(event == "reacquired").alias("reacquired"),
        F.count_if(event == "impossible_motion").alias("impossible"),
        F.coalesce(F.max(gap), F.lit(0)).cast("long").alias("longest_gap"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_gap"),
        F.percentile(F.when(observed, F.col("confidence")), F.array(*[F.lit(q) for q in (0.1, 0.5, 0.9)])).alias("p"),
    )
    base = frames.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("frames"), F.count("x").alias("detected"))
    counters = ("observed", "interpolated", "segments", "reacquired", "impossible", "longest_gap")
    out = base.join(found, "analysis_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})
    status = F.when(F.col("observed") == 0, "no_ball_detected").when(F.col("observed") < rule.min_observations, "insufficient_observations")
    status = status.when((F.col("segments") >= 3) & (F.col("segments") == F.col("observed")), "excessive_track_fragmentation").otherwise("available")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return out.select(
        "analysis_id", "frames", "detected", share("detected", "frames").alias("coverage"), F.round((F.col("observed") + F.col("interpolated")) / F.col("frames"), 6).alias("path_coverage"), *counters,
        F.round(F.coalesce("mean_gap", F.lit(0.0)), 6).alias("mean_gap"), F.round(F.greatest(F.col("segments") - 1, F.lit(0)) / F.greatest("observed", F.lit(1)), 6).alias("fragmentation"),
        *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], status.alias("status"),
    )


def detections(frames: DataFrame) -> DataFrame:
    """Coverage, linear percentiles of confidence and gaps between detections."""
    seen = with_previous(frames.where("x IS NOT NULL"), ["analysis_id"], ["frame"], ["frame"]).withColumn("gap", F.col("frame") - F.col("prev_frame") - 1)
    p = F.percentile("confidence", F.array(*[F.lit(q) for q in (0.1, 0.5, 0.9)]))
    stats = seen.groupBy("analysis_id").agg(p.alias("p"), F.max("gap").cast("long").alias("longest_gap"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("mean_gap"))
    base = frames.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("frames"), F.count("x").alias("detected"))
    return base.join(stats, "analysis_id", "left").select(
        "analysis_id", "frames", "detected", F.round(F.col("detected") / F.col("frames"), 6).alias("coverage"), *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "longest_gap", F.round("mean_gap", 9).alias("mean_gap")
    )
