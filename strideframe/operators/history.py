"""Contribution ladders, chronological splits and ratio-of-sums trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The outcome of the first condition that holds."""
    out = F.when(*steps[0])
    for condition, outcome in steps[1:]:
        out = out.when(condition, outcome)
    return out.otherwise(otherwise)


def chronological_split(df: DataFrame, keys: list[str], order: list[str], window: int = 8) -> DataFrame:
    """The newest `window` rows of a key, older half 'earlier', newer half 'recent' (the newer one larger), with their number."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("back", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("back") <= window)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("n", n).withColumn("split", F.when(F.col("back") <= F.ceil(F.col("n") / 2), "recent").otherwise("earlier")).drop("back")


def even_split(df: DataFrame, keys: list[str], own: str, order: str, window: int = 8, least: int = 4) -> DataFrame:
    """Of each id `own` of a key the newest row by `order`; of these the newest `window`, the first n // 2 'earlier', the last n // 2 'recent'.

    The middle row of an odd n has a null split, as have all rows of a key with fewer than `least`."""
    last = F.row_number().over(Window.partitionBy(*keys, own).orderBy(F.desc(order)))
    df = df.withColumn("back", last).where(F.col("back") == 1)
    w = Window.partitionBy(*keys)
    df = df.withColumn("back", F.row_number().over(w.orderBy(F.desc(order), F.desc(own)))).where(F.col("back") <= window)
    df = df.withColumn("n", F.count(F.lit(1)).over(w))
    half = F.floor(F.col("n") / 2)
    split = F.when(F.col("n") < least, None).when(F.col("back") <= half, "recent").when(F.col("back") > F.col("n") - half, "earlier")
    return df.withColumn("split", split).drop("back")


def trend(change: Column, tolerance: float) -> Column:
    return F.when(F.abs(change) < tolerance, "STABLE").when(change > 0, "HIGHER").when(change < 0, "LOWER")


def newest_first(df: DataFrame, keys: list[str], order: list[Column], page: int, size: int) -> DataFrame:
    """Page `page` (from 0) of each key's rows, with the row's number."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank").between(page * size + 1, (page + 1) * size))


def joined_record(analyses: DataFrame, analytics: DataFrame, match_iq: DataFrame) -> DataFrame:
    """`analyses` (analysis_id, updated_at, tracked_seconds, …) with what is known of each: analytics (analysis_id, made_at, observed_seconds, …) and match intelligence
    (analysis_id, made_at, status), either of which may be missing. Reliable seconds are the analytics', else the tracked ones of the recording check."""
    a = analytics.select("analysis_id", F.col("made_at").alias("__a"), *[c for c in analytics.columns if c not in ("analysis_id", "made_at")])
    m = match_iq.select("analysis_id", F.col("made_at").alias("__m"), F.col("status").alias("__status"))
    rows = analyses.join(a, "analysis_id", "left").join(m, "analysis_id", "left")
    known = {
        "evaluated_at": F.greatest("updated_at", "__a", "__m"),
        "reliable_seconds": F.coalesce("observed_seconds", "tracked_seconds"),
        "measurement_available": F.col("__a").isNotNull(),
        "match_iq_available": F.coalesce(F.col("__status") == "generated", F.lit(False)),
    }
    return rows.withColumns(known).drop("__a", "__m", "__status")


def comparison_groups(split: DataFrame, keys: list[str], at: str, sums: list[str]) -> DataFrame:
    """One row per key and half of even_split(): its period, analyses with their ids in order (a window's half at most), and the sums."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(at, "analysis_id"))), lambda x: x["analysis_id"])
    total = [F.sum(c).alias(c) for c in sums]
    return split.where("split IS NOT NULL").groupBy(*keys, "split").agg(F.min(at).alias("period_start"), F.max(at).alias("period_end"), F.count(F.lit(1)).alias("analyses"), ids.alias("analysis_ids"), *total)


def share_changes(groups: DataFrame, keys: list[str], parts: list[str], least: float) -> DataFrame:
    """Per key the shares of `parts` in their sum in both halves, in percent, and the part whose share changed most: the first of equals; `style_status` says whether by `least` points.

    A half without a sum has no shares; without two halves with shares there is no pick."""
    whole = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    rows = groups.withColumns({f"{p}_share": F.try_divide(F.col(p), whole) * 100 for p in parts})
    half = lambda p, s: F.max(F.when(F.col("split") == s, F.col(f"{p}_share")))
    out = rows.groupBy(*keys).agg(*[half(p, s).alias(f"{p}_{s}") for p in parts for s in ("earlier", "recent")])
    moves = [F.when(F.col(f"{p}_recent").isNotNull() & F.col(f"{p}_earlier").isNotNull(), F.struct(F.abs(F.col(f"{p}_recent") - F.col(f"{p}_earlier")).alias("size"), F.lit(-i).alias("i"), F.lit(p).alias("part"), (F.col(f"{p}_recent") - F.col(f"{p}_earlier")).alias("change"))) for i, p in enumerate(parts)]
    pick = F.array_max(F.array_compact(F.array(*moves)))
    out = out.withColumn("__pick", pick)
    status = F.when(F.col("__pick").isNull(), None).when(F.col("__pick.size") < least, "NO_CLEAR_CHANGE").otherwise("PROVISIONAL_CHANGE")
    return out.withColumns({"style": F.col("__pick.part"), "style_change": F.col("__pick.change"), "style_status": status}).drop("__pick")


#: The gate that a recording's quality stands for where no match intelligence has spoken.
GATE_OF_QUALITY = {"EXCELLENT": "NORMAL", "GOOD": "CAUTIOUS", "LIMITED": "MEASUREMENT_ONLY", "UNSUITABLE": "INSUFFICIENT_EVIDENCE"}


def system_gate(iq_gate: Column, quality: Column) -> Column:
    """The gate of the match intelligence, else of the recording's quality; null for neither."""
    of_quality = F.when(*[(quality == q, g) for q, g in GATE_OF_QUALITY.items()][0])
    for q, g in list(GATE_OF_QUALITY.items())[1:]:
        of_quality = of_quality.when(quality == q, g)
    return F.coalesce(iq_gate, of_quality)
