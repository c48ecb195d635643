"""Decision ladders as column expressions: window states, contribution and comparability of reports, trends, recording checks, insight gates, readiness.

Each function takes a DataFrame with the named inputs and adds its verdict. Ladders are CASE expressions in the order of their rules; lists of codes keep
the rules' order unless they are said to be sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class WindowPolicy:
    """Fixed values of the window classifier."""

    window_seconds: float = 3.0
    min_context: float = 6.0
    min_reliable: int = 2
    coverage: float = 0.65
    strong_coverage: float = 0.85
    minor_gap: float = 0.15
    severe_gap: float = 0.35
    active_intensity: float = 0.25
    idle_intensity: float = 0.12
    player_coverage: float = 0.55
    direction_rate: float = 0.08


@dataclass(frozen=True)
class ReportPolicy:
    """Fixed values of the report ladders."""

    visibility: float = 0.65
    tracked_seconds: float = 5.0
    gap_ratio: float = 0.50
    fragments: int = 3
    min_observations: int = 3
    min_tracked: float = 1.0
    cautious_seconds: float = 15.0
    baseline: int = 3
    per_group: int = 2


@dataclass(frozen=True)
class RecordingPolicy:
    """Fixed values of the recording checks: (blocks below, warns below, excellent from)."""

    short_edge: tuple[float, float, float] = (480, 720, 1080)
    fps: tuple[float, float, float] = (15, 24, 30)
    duration: tuple[float, float] = (10, 60)
    tracked: tuple[float, float] = (5, 30)
    visibility: tuple[float, float] = (0.65, 0.85)
    gap_warn: float = 0.10
    gap_block: float = 0.50
    fragments: int = 3


def code_list(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(ok, F.lit(code)) for ok, code in rules]))


def gap_severity(gap: Column, p: WindowPolicy = WindowPolicy()) -> Column:
    return F.when(gap >= p.severe_gap, "SEVERE").when(gap >= p.minor_gap, "MINOR").otherwise("NONE")


def classified_windows(df: DataFrame, p: WindowPolicy = WindowPolicy()) -> DataFrame:
    """State, confidence and sorted reason codes of feature windows.

    Inputs: visible, reliable, fragments (most of a reliable player), coverage, gap_ratio, window_seconds, source_seconds, quality (null: not assessed), current, moving,
    simultaneous, intensity, kitchen, stationary_seconds, direction_rate.
    """
    df = df.withColumn("gap_severity", gap_severity(c("gap_ratio"), p))
    severe = c("gap_severity") == "SEVERE"
    continuity = F.when(c("reliable") == 0, "NOT_AVAILABLE").when(severe, "POOR").when((c("gap_severity") == "NONE") & (c("fragments") == 1), "STRONG").otherwise("LIMITED")
    visibility = F.when(c("reliable") < p.min_reliable, "NOT_AVAILABLE").when(c("coverage") >= p.strong_coverage, "HIGH").when(c("coverage") >= p.coverage, "MODERATE").otherwise("LOW")
    df = df.withColumns({"continuity": continuity, "visibility": visibility})
    few, thin = c("reliable") < p.min_reliable, c("coverage") < p.coverage
    unsuitable = F.coalesce(c("quality") == "UNSUITABLE", F.lit(False))
    short = (c("source_seconds") < p.min_context) | (c("window_seconds") < p.window_seconds - 1e-6)
    closed = few | thin | severe | unsuitable | short | ~c("current")
    active = ~closed & (c("moving") >= p.min_reliable) & c("simultaneous") & (c("intensity") >= p.active_intensity)
    still = (c("moving") == 0) & (c("kitchen") == 0) & (c("intensity") <= p.idle_intensity) & (c("stationary_seconds") >= c("window_seconds") * p.player_coverage)
    idle = ~closed & ~active & still
    other = ~closed & ~active & ~idle
    supported = F.when((c("coverage") >= p.strong_coverage) & (c("continuity") == "STRONG") & (c("visibility") == "HIGH"), "MODERATE").otherwise("LOW")
    codes = code_list(
        (c("visible") == 0, "NO_OBSERVATIONS"), (few, "INSUFFICIENT_RELIABLE_PLAYERS"), (c("reliable") == 1, "ONE_PLAYER_ONLY"),
        (~thin, "SUFFICIENT_TRACKED_COVERAGE"), (thin, "INSUFFICIENT_TRACKED_COVERAGE"), (c("gap_severity") != "NONE", "TRACKING_GAP"), (severe, "SEVERE_TRACKING_GAPS"),
        (c("continuity").isin("LIMITED", "POOR"), "FRAGMENTED_CANDIDATES"), (unsuitable, "UNSUITABLE_RECORDING"), (short, "SHORT_CONTEXT"), (~c("current"), "STALE_SOURCE_ARTIFACT"),
        (active, "SUSTAINED_MULTI_PLAYER_MOVEMENT"), (active, "SIMULTANEOUS_MOVEMENT"), (active & (c("direction_rate") >= p.direction_rate), "MEANINGFUL_DIRECTION_CHANGES"),
        (active & (c("moving") < c("reliable")), "STATIONARY_PLAYER_WITH_ACTIVE_PEERS"), (idle, "SUSTAINED_LOW_MOVEMENT"), (idle, "STABLE_LOW_ACTIVITY"),
        (other & (c("kitchen") > 0), "KITCHEN_LOW_MOVEMENT_SAFEGUARD"), (other, "CONFLICTING_EVIDENCE"),
    )
    return df.withColumns(
        {
            "state": F.when(active, "LIKELY_ACTIVE").when(idle, "LIKELY_IDLE").otherwise("UNKNOWN"),
            "confidence": F.when(active | idle, supported).when(other, "LOW").otherwise("NOT_AVAILABLE"),
            "reason_codes": F.array_sort(codes),
        }
    )


def contributions(df: DataFrame, p: ReportPolicy = ReportPolicy()) -> DataFrame:
    """Whether a report contributes to a history, with the codes of why.

    Inputs: status, blocking (has blocking failures), analytics_completed, has_analytics, readiness (null: none), has_signals, visibility, tracked_seconds, gap_ratio,
    fragments, observed_seconds, zone_seconds, measurement.
    """
    weak = code_list(
        (c("visibility").isNull(), "MISSING_OBSERVATION_COVERAGE"), (c("visibility") < p.visibility, "INSUFFICIENT_OBSERVATION_COVERAGE"),
        (c("tracked_seconds") < p.tracked_seconds, "INSUFFICIENT_USABLE_DURATION"), (c("gap_ratio") > p.gap_ratio, "FRAGMENTED_PLAYER_TRACKING"),
        (c("fragments") > p.fragments, "TOO_MANY_TRACK_FRAGMENTS"), (c("observed_seconds") <= 0, "MISSING_RELIABLE_OBSERVATION"),
        (c("zone_seconds") <= 0, "MISSING_MOVEMENT_MEASUREMENTS"), (c("measurement").isin("LOW", "NOT_AVAILABLE"), "WEAK_MEASUREMENT_CONFIDENCE"),
    )
    unsuitable = c("readiness").isNotNull() & ((c("readiness") == "UNSUITABLE") | c("blocking"))
    ladder = (
        (c("status") == "failed", "EXCLUDED", ["ANALYSIS_FAILED"]),
        (unsuitable, "EXCLUDED", ["UNSUITABLE_RECORDING", "BLOCKING_EVIDENCE_FAILURE"]),
        (c("status").isin("pending", "processing"), "PROVISIONAL", ["ANALYSIS_IN_PROGRESS"]),
        (~c("analytics_completed"), "PROVISIONAL", ["ANALYSIS_INCOMPLETE"]),
        (~c("has_analytics"), "NOT_EVALUATED", ["LEGACY_ANALYTICS_UNAVAILABLE"]),
        (c("readiness").isNull() | ~c("has_signals"), "NOT_EVALUATED", ["LEGACY_EVIDENCE_UNAVAILABLE"]),
    )
    weak_verdict = F.when(F.size(weak) > 0, "EXCLUDED").otherwise("INCLUDED")
    weak_codes = F.when(F.size(weak) > 0, weak).otherwise(F.array(F.lit("EVIDENCE_STANDARD_MET")))
    (first, verdict, codes), *rest = ladder
    verdicts, code_case = F.when(first, verdict), F.when(first, F.array(*map(F.lit, codes)))
    for when, verdict, codes in rest:
        verdicts, code_case = verdicts.when(when, verdict), code_case.when(when, F.array(*map(F.lit, codes)))
    return df.withColumns({"contribution": verdicts.otherwise(weak_verdict), "contribution_codes": code_case.otherwise(weak_codes)})


def comparability(df: DataFrame) -> DataFrame:
    """Whether a report can be compared with others; PROVISIONAL at best. Inputs: contribution, has_analytics, observed_seconds, zone_seconds, tracking, measurement (null: no confidence), readiness."""
    weak = lambda name: F.coalesce(c(name).isin("LOW", "NOT_AVAILABLE"), F.lit(False))
    verdict = (
        F.when(c("contribution") == "PROVISIONAL", "PROVISIONAL").when(c("contribution") == "NOT_EVALUATED", "NOT_EVALUATED").when(c("contribution") == "EXCLUDED", "INELIGIBLE")
        .when(~c("has_analytics"), "NOT_EVALUATED").when((c("observed_seconds") <= 0) | (c("zone_seconds") <= 0), "INELIGIBLE")
        .when(weak("tracking") | weak("measurement"), "INELIGIBLE").otherwise("PROVISIONAL")
    )
    best = (c("contribution") == "INCLUDED") & (verdict == "PROVISIONAL")
    limits = code_list(
        (best, "match_format_unknown"), (best, "camera_placement_unknown"), (best & (c("readiness") == "LIMITED"), "limited_recording"),
        (best & c("tracking").isNull() & c("measurement").isNull(), "confidence_unavailable"),
    )
    return df.withColumns({"comparability": verdict, "comparability_limits": limits})


def history_labels(df: DataFrame) -> DataFrame:
    """The status of a report in a history and the limitation shown with it. Inputs: status, readiness, analytics_completed, contribution."""
    quality = F.coalesce("readiness", F.lit(""))
    status = (
        F.when(c("status") == "failed", "FAILED").when(quality == "UNSUITABLE", "UNSUITABLE").when(c("status").isin("pending", "processing"), "PROCESSING")
        .when(quality == "LIMITED", "LIMITED").when((c("status") == "completed") & c("analytics_completed"), "READY").otherwise("LEGACY")
    )
    limitation = F.when(c("status") == "failed", "failed").when(quality == "UNSUITABLE", "unsuitable").when(quality == "LIMITED", "limited")
    return df.withColumns({"history_status": status, "limitation": limitation})


def trend_eligibility(df: DataFrame, p: ReportPolicy = ReportPolicy()) -> DataFrame:
    """Trend, baseline and interpretation verdicts. Inputs: qualified, comparable, versions, provisional (counts) and has_metrics. Groups are the halves of the comparable reports."""
    half = F.floor(c("comparable") / 2)
    trend = (
        F.when(c("comparable") == 0, "INELIGIBLE").when(c("versions") > 1, "INELIGIBLE").when(c("comparable") < p.baseline, "INELIGIBLE")
        .when(c("comparable") == p.baseline, "PROVISIONAL").when(half < p.per_group, "INELIGIBLE").when(c("provisional") > 0, "PROVISIONAL").otherwise("ELIGIBLE")
    )
    df = df.withColumn("trend", trend)
    baseline = (
        F.when(c("qualified") == 0, "NO_QUALIFIED_REPORTS")
        .when(c("comparable") < p.baseline, F.when(c("qualified") >= p.baseline, "MIXED_OR_INCOMPATIBLE_REPORTS").otherwise("BUILDING_BASELINE"))
        .when(c("comparable") == p.baseline, "BASELINE_ESTABLISHED").when(c("trend") == "INELIGIBLE", "MIXED_OR_INCOMPATIBLE_REPORTS").otherwise("COMPARISON_AVAILABLE")
    )
    reading = F.when(c("trend") == "INELIGIBLE", "NOT_EVALUATED").when(~c("has_metrics"), "INELIGIBLE").otherwise("PROVISIONAL")
    ready = F.concat(baseline, F.lit(": "), c("comparable").cast("string"), F.lit(f" of {p.baseline}"))
    return df.withColumns({"baseline": baseline, "interpretation": reading, "readiness_text": ready})


def insight_gate(df: DataFrame, p: ReportPolicy = ReportPolicy()) -> DataFrame:
    """Gate, five confidences, what is said of missing data, limitations and summary. Inputs: observations, zone_seconds, readiness, fragments, unobserved, observed_seconds, insights, action."""
    quality = F.coalesce("readiness", F.lit(""))
    enough = (c("observations") >= p.min_observations) & (c("zone_seconds") >= p.min_tracked)
    gate = (
        F.when(~enough | (quality == "UNSUITABLE"), "INSUFFICIENT_EVIDENCE").when(quality == "LIMITED", "MEASUREMENT_ONLY")
        .when((c("fragments") > 1) | (c("unobserved") > 0) | (c("observed_seconds") < p.cautious_seconds), "MEASUREMENT_ONLY")
        .when(quality.isin("", "GOOD"), "CAUTIOUS").otherwise("NORMAL")
    )
    df = df.withColumn("gate", gate)
    read = c("gate").isin("NORMAL", "CAUTIOUS")
    reading = F.when(read, "MODERATE").otherwise("NOT_AVAILABLE")
    missing = F.when(quality == "UNSUITABLE", "unsuitable_recording").when(c("observations") < p.min_observations, "few_observations").when(c("zone_seconds") < p.min_tracked, "little_tracked_time")
    return df.withColumns(
        {
            "recording_confidence": F.when(quality == "", "NOT_AVAILABLE").when(quality == "EXCELLENT", "HIGH").when(quality == "GOOD", "MODERATE").otherwise("LOW"),
            "tracking_confidence": F.when((c("fragments") == 1) & (c("unobserved") == 0), "MODERATE").otherwise("LOW"),
            "measurement_confidence": F.when(enough, "MODERATE").otherwise("LOW"),
            "interpretation_confidence": reading,
            "recommendation_confidence": reading,
            "insufficient_reason": missing,
            "limitations": code_list((c("unobserved") > 0, "unobserved_gap"), (c("fragments") > 1, "several_fragments"), (quality == "", "legacy_recording")),
            "summary": F.when(c("gate") == "MEASUREMENT_ONLY", "suppressed").when(c("insights") > 0, F.concat(c("insights").cast("string"), F.when(c("insights") == 1, " observation").otherwise(" observations"))).otherwise("none"),
            "focus": F.when(read & (c("insights") > 0), c("action")),
            "may_interpret": read,
        }
    )


def recording_checks(df: DataFrame, p: RecordingPolicy = RecordingPolicy()) -> DataFrame:
    """Upload preflight: failures, warnings and level. Inputs: width, height, fps, duration."""
    edge = F.least("width", "height")
    fails = code_list((edge < p.short_edge[0], "LOW_RESOLUTION"), (c("fps") < p.fps[0], "LOW_FRAME_RATE"), (c("duration") < p.duration[0], "TOO_SHORT"))
    warns = code_list(
        (c("height") > c("width"), "VERTICAL_VIDEO"), ((edge >= p.short_edge[0]) & (edge < p.short_edge[1]), "REDUCED_RESOLUTION"), ((c("fps") >= p.fps[0]) & (c("fps") < p.fps[1]), "REDUCED_FRAME_RATE")
    )
    excellent = (edge >= p.short_edge[2]) & (c("fps") >= p.fps[2]) & (c("duration") >= p.duration[1])
    df = df.withColumns({"failures": fails, "warnings": warns, "resolution": F.when(edge >= 1080, "1080p").when(edge >= 720, "720p")})
    return df.withColumn("level", level(c("failures"), c("warnings"), excellent))


def level(failures: Column, warnings: Column, excellent: Column) -> Column:
    return F.when(F.size(failures) > 0, "UNSUITABLE").when(F.size(warnings) > 0, "LIMITED").when(excellent, "EXCELLENT").otherwise("GOOD")


def readiness_checks(df: DataFrame, p: RecordingPolicy = RecordingPolicy()) -> DataFrame:
    """Analysis readiness. Inputs: upload (level), calibrated, people, selectable, quality, visibility, tracked, span, fragments."""
    gap = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), c("span") - c("tracked")), c("span")), F.lit(0.0))
    fails = code_list(
        (c("upload") == "UNSUITABLE", "UPLOAD_UNSUITABLE"), (~c("calibrated"), "CALIBRATION_MISSING"), (c("people") == 0, "NO_PEOPLE"), (c("selectable") == 0, "NO_SELECTABLE_PLAYER"),
        (c("visibility") < p.visibility[0], "LOW_VISIBILITY"), (c("tracked") < p.tracked[0], "SHORT_TRACK"), (gap > p.gap_block, "LARGE_GAPS"), (c("fragments") > p.fragments, "MANY_FRAGMENTS"),
    )
    warns = code_list(
        (c("upload") == "LIMITED", "UPLOAD_LIMITED"), (c("quality") != "STRONG", "CANDIDATE_NOT_STRONG"), ((c("tracked") >= p.tracked[0]) & (c("tracked") < p.tracked[1]), "REDUCED_TRACK"),
        ((gap <= p.gap_block) & ((gap > p.gap_warn) | (c("fragments") > 1)), "TRACKING_GAPS"),
    )
    best = (c("upload") == "EXCELLENT") & (c("quality") == "STRONG") & (c("tracked") >= p.tracked[1]) & (c("visibility") >= p.visibility[1]) & (gap <= p.gap_warn) & (c("fragments") == 1)
    df = df.withColumns({"failures": fails, "warnings": warns})
    return df.withColumns({"level": level(c("failures"), c("warnings"), best), "reason_codes": F.concat("failures", "warnings")})


def count_metric(numerator: Column, denominator: Column, samples: Column, least: int = 5) -> dict[str, Column]:
    """Availability of a count metric, its percentage (rounded half to even, hidden while provisional) and its text."""
    state = F.when(denominator == 0, "NOT_REVIEWED").when(samples < least, "PROVISIONAL").otherwise("AVAILABLE")
    percent = F.bround(F.try_divide(numerator, denominator) * 100, 1)
    share = F.when(percent.isNull(), "not available").otherwise(F.format_string("%.1f%%", percent))
    text = F.format_string("%d/%d (%s)%s", numerator, denominator, share, F.when(samples < least, " — provisional").otherwise(""))
    return {"availability": state, "percent": F.when(state == "AVAILABLE", percent), "text": text}


def ordinal_least(column: Column, ranks: list[str]) -> Column:
    """The value of a group that stands first in `ranks`."""
    place = F.min(F.array_position(F.array(*map(F.lit, ranks)), column))
    return F.get(F.array(*map(F.lit, ranks)), (place - 1).cast("int"))
