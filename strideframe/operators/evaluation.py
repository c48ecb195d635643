"""What reviewers and the system disagree on, sample by sample, and histograms of the reasons.

Samples are rows of SAMPLE. Everything starts from one explode of an array of structs per sample, so no sample's or category's rows are ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = (
    "sample_id string, status string, system_quality string, expected_quality string, quality_delta int, system_gate string, expected_gate string, reason_codes array<string>, errors array<string>, "
    "artifacts array<struct<artifact:string,compatibility:string>>, artifact_readiness string, identity_reviewed boolean, "
    "mappings array<struct<candidate_id:string,role:string,player_id:string,correct:string>>, "
    "tracking array<struct<candidate_id:string,player_id:string,start_s:double,end_s:double,identity:string,continuity:string>>, "
    "insights array<struct<insight_id:string,gate:string,measurement_correct:string,interpretation_justified:string,confidence_appropriate:string,limitation_accurate:string,action_conservative:string,wording_understandable:string>>, "
    "active_play array<struct<start_s:double>>, incomplete array<string>"
)
#: What a refused field of an insight counts as.
INSIGHT_FIELDS = {
    "measurement_correct": "MEASUREMENT", "interpretation_justified": "INSIGHT_GATING", "confidence_appropriate": "INSIGHT_GATING", "limitation_accurate": "INSIGHT_GATING",
    "action_conservative": "INSIGHT_GATING", "wording_understandable": "WORDING",
}
#: The categories of the summary; None where no review speaks of them.
CATEGORIES = (
    "incomplete_annotation", "recording_assessment", "artifact_compatibility", "player_identity", "candidate_association", "tracking_continuity", "measurement", "insight_gating", "confidence",
    "wording", "active_play_state", "active_play_boundary",
)
_FOUND = "array<struct<category:string,output:string,expectation:string,reason:string,rule:string>>"


def _row(category, output, expectation, reason, rule) -> Column:
    values = {"category": category, "output": output, "expectation": expectation, "reason": reason, "rule": rule}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(k) for k, v in values.items()])


def _when(condition: Column, row: Column) -> Column:
    return F.when(condition, F.array(row)).otherwise(F.array().cast(_FOUND))


def _each(items: str, condition, row) -> Column:
    return F.coalesce(F.transform(F.filter(items, condition), row), F.array().cast(_FOUND))


def _refused(field: str, kind: str) -> Column:
    return _each("insights", lambda i: i[field] == "NO", lambda i: _row(kind, F.concat(i["insight_id"], F.lit(f":{field}")), "YES", f"Reviewer marked {field} incorrect.", i["gate"]))


def disagreements(samples: DataFrame) -> DataFrame:
    """(sample_id, category, output, expectation, reason, rule, evidence): a row per field on which reviewer and system disagree, and one for an incomplete review."""
    s = F.col
    parts = [
        _when(s("system_quality") != s("expected_quality"), _row("RECORDING_ASSESSMENT", s("system_quality"), s("expected_quality"), "Court4 recording quality differs from the reviewed verdict.", "RecordingQualityThresholds")),
        _when(s("system_gate") != s("expected_gate"), _row("INSIGHT_GATING", s("system_gate"), s("expected_gate"), "Court4 evidence gate differs from the reviewed gate.", "Match IQ quality gate")),
        _each("mappings", lambda m: m["correct"] == "NO", lambda m: _row(
            "CANDIDATE_ASSOCIATION", m["candidate_id"], F.concat_ws(":", m["role"], F.coalesce(m["player_id"], F.lit("no-player"))), "Reviewer marked the candidate-to-player mapping incorrect.", "candidate association")),
        _each("tracking", lambda t: (t["identity"] == "NO") | (t["continuity"] == "BROKEN"), lambda t: _row(
            "TRACKING_CONTINUITY", F.coalesce(t["candidate_id"], F.lit("no candidate")), F.concat(t["player_id"], F.lit(" from "), short_number(t["start_s"]), F.lit("-"), short_number(t["end_s"]), F.lit("s")),
            "Reviewed interval contains an identity error or broken continuity.", "tracking continuity")),
        *[_refused(field, kind) for field, kind in INSIGHT_FIELDS.items()],
        _when(F.coalesce(F.size("incomplete"), F.lit(0)) > 0, _row("INCOMPLETE_ANNOTATION", s("status"), "Complete independent review", F.concat(F.lit("Unreviewed fields: "), F.array_join("incomplete", ", ")), None)),
    ]
    evidence = F.coalesce(F.transform("artifacts", lambda a: F.concat_ws(":", a["artifact"], a["compatibility"])), F.array().cast("array<string>"))
    return samples.select("sample_id", F.explode(F.concat(*parts)).alias("d"), evidence.alias("evidence")).select("sample_id", "d.*", "evidence")


def short_number(value: Column) -> Column:
    """A number as %g writes it where six digits are enough: no zeros behind the point."""
    return F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", "")


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys[:-1]).orderBy(F.desc("n"), keys[-1]) if len(keys) > 1 else Window.orderBy(F.desc("n"), keys[-1])
    return counts.withColumn("place", F.row_number().over(order))  # a row per code


def failure_reasons(samples: DataFrame) -> DataFrame:
    """How often each reason code and artifact error stands, most frequent first, then by name."""
    none = F.array().cast("array<string>")
    return _counted(samples.select(F.explode(F.concat(F.coalesce("reason_codes", none), F.coalesce("errors", none))).alias("reason")), ["reason"])


def policy_errors(samples: DataFrame) -> DataFrame:
    """Reasons by the kind of wrong verdict: quality too high or too low, a gate passed or closed wrongly. A sample without an assessment counts as missing_assessment."""
    low = "INSUFFICIENT_EVIDENCE"
    expected, actual, delta = F.col("expected_gate"), F.col("system_gate"), F.col("quality_delta")
    kinds = {
        "quality_overestimation": delta > 0, "quality_underestimation": delta < 0, "false_acceptance": (expected == low) & (actual != low), "false_suppression": expected.isin("NORMAL", "CAUTIOUS") & (actual == low),
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    reasons = F.coalesce("reason_codes", F.array(F.lit("missing_assessment")))
    rows = samples.select(F.explode(named).alias("kind"), reasons.alias("reasons")).select("kind", F.explode("reasons").alias("reason"))
    return _counted(rows, ["kind", "reason"])


def _summary_rows(samples: DataFrame) -> DataFrame:
    """(sample_id, category): samples that each category of the summary is open in."""
    found = disagreements(samples).select("sample_id", F.lower("category").alias("category")).where(F.col("category") != "tracking_continuity")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    gaps = {
        "artifact_compatibility": ~F.col("artifact_readiness").eqNullSafe("READY"), "player_identity": F.col("identity_reviewed").isNull(), "tracking_continuity": empty("tracking"),
        "active_play_state": empty("active_play"), "active_play_boundary": F.exists("active_play", lambda i: i["start_s"].isNull()),
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in gaps.items()]))
    return found.unionByName(samples.select("sample_id", F.explode(named).alias("category"))).distinct()


def summary(samples: DataFrame, first: int = 10) -> DataFrame:
    """All CATEGORIES with how many samples they are open in and the first of these by id; count null and NOT_REVIEWED where no review speaks of them.

    The filter on the row number keeps `first` rows of a category in each task before the shuffle, so no category is collected.
    """
    rows = _summary_rows(samples)
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("sample_id"))
    ids = rows.withColumn("place", place).where(F.col("place") <= first).groupBy("category").agg(F.array_sort(F.collect_list("sample_id")).alias("first_ids"))
    played = samples.agg(F.coalesce(F.max(F.size("active_play") > 0), F.lit(False)).alias("played"))
    dense = samples.sparkSession.createDataFrame([(k, c) for k, c in enumerate(CATEGORIES)], "number int, category string")
    out = dense.join(counts, "category", "left").join(ids, "category", "left").join(F.broadcast(played), F.lit(True))
    open_ = F.when(F.col("category") == "confidence", False).when(F.col("category").startswith("active_play"), F.col("played")).otherwise(True)
    none = F.array().cast("array<string>")
    return out.select("number", "category", F.when(open_, F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("first_ids", none).alias("first_ids"), F.when(open_, "AVAILABLE").otherwise("NOT_REVIEWED").alias("availability"))


#: Labels of quality from worst to best, and the gates that a review can expect.
QUALITY_ORDER = ("UNSUITABLE", "LIMITED", "GOOD", "EXCELLENT")
REVIEWED_GATES = ("INSUFFICIENT_EVIDENCE", "MEASUREMENT_ONLY", "CAUTIOUS", "NORMAL")


def outcomes(samples: DataFrame) -> DataFrame:
    """Adds to samples (system_quality, verdict, label, system_gate, expected_gate, warnings, errors): the expected quality, a reviewed verdict or else the label; its
    distance to the system's; whether it is exact or within one step; whether the gates agree; null where either side is missing. `outcome`: FAILED with neither
    quality nor gate of the system, PARTIAL with a warning or an error, else EVALUATED."""
    rank = lambda q: F.nullif(F.array_position(F.array(*map(F.lit, QUALITY_ORDER)), q), F.lit(0))
    expected = F.when(F.col("verdict").isin(*QUALITY_ORDER), F.col("verdict")).otherwise(F.col("label"))
    df = samples.withColumn("expected_quality", expected)
    delta = (rank(F.col("system_quality")) - rank(F.col("expected_quality"))).cast("int")
    clean = (F.coalesce(F.size("warnings"), F.lit(0)) <= 0) & (F.coalesce(F.size("errors"), F.lit(0)) <= 0)
    return df.withColumn("quality_delta", delta).withColumns(
        {
            "exact": F.col("quality_delta") == 0,
            "acceptable": F.abs("quality_delta") <= 1,
            "gate_agrees": F.when(F.col("expected_gate").isin(*REVIEWED_GATES), F.col("system_gate") == F.col("expected_gate")),
            "outcome": F.when(F.col("system_quality").isNull() & F.col("system_gate").isNull(), "FAILED").when(clean, "EVALUATED").otherwise("PARTIAL"),
        }
    )


def optional_count(explicit: Column) -> Column:
    """The sum of what reviewers counted; null, not 0, where none did."""
    return F.sum(explicit)


def count_or_role(explicit: Column, mappings: str, role: str) -> Column:
    """A reviewer's own count, else how many of the mappings have the role; null without mappings."""
    return F.coalesce(explicit, F.when(F.size(mappings) > 0, F.size(F.filter(mappings, lambda m: m["role"] == role))))


def duration_rate(part: Column, whole: Column, intervals: Column, provisional: Column) -> dict[str, Column]:
    """The percentage of a duration, null for none, and its text, rounded as binary numbers are: tenfold, to the next integer."""
    percent = F.when(whole > 0, part / whole * 100)
    share = F.when(percent.isNull(), "not available").otherwise(F.format_string("%.1f%%", F.round(percent * 10) / 10))
    text = F.format_string("%.3f/%.3fs (%s; %d intervals)%s", part, whole, share, intervals, F.when(provisional, " — provisional").otherwise(""))
    return {"percent": percent, "text": text}


def raw_metric(total: Column, labelled: Column, least: int) -> dict[str, Column]:
    """A count over labelled samples, for which a percentage means nothing, with its note."""
    thin = labelled < least
    note = F.format_string("Raw total across %d labeled samples; a percentage is not meaningful.", labelled)
    return {"provisional": thin, "note": F.concat(note, F.when(thin, F.lit(f" Coverage is provisional below {least} reviewed samples.")).otherwise(""))}
