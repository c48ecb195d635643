"""Fragment association: candidate edges, order-dependent grouping, and roll-ups of the groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.policy import AssociationPolicy
from ..session import written
from .windows import with_next

EDGE_REASONS = ["non_overlapping_fragments", "short_temporal_gap", "plausible_endpoint_distance", "plausible_movement_speed", "similar_bounding_box_size", "court_side_consistent"]
#: Fixed value: tasks that the ends of one time bucket are dealt out to; its starts are shuffled as often.
SPREAD = 4
#: Links of an analysis that are folded at once, the steps in which more of them are cut, and fragments of an analysis per band of gaps.
FOLD_LINKS = 200_000
CUTS = 1_000
BAND_FRAGMENTS = 256
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
EDGE_ORDER = ["gap_us", "distance", "area_ratio", "from_track", "to_track"]


def intervals(obs: DataFrame) -> DataFrame:
    """(track_id, gap_us): the times between a track's consecutive rows, where they differ."""
    pairs = with_next(obs, ["track_id"], ["ts_us", "frame_index"], ["ts_us"])
    return pairs.select("track_id", (F.col("next_ts_us") - F.col("ts_us")).alias("gap_us")).where("gap_us > 0")


def _with_gaps(fragments: DataFrame, gaps: DataFrame | None) -> DataFrame:
    """Adds `gaps`, a track's intervals in order, and `median_gap`, the upper median of these; both null without any."""
    if gaps is None:
        return fragments.withColumns({"gaps": F.lit(None).cast("array<long>"), "median_gap": F.lit(None).cast("long")})
    own = gaps.groupBy("track_id").agg(F.sort_array(F.collect_list("gap_us")).alias("gaps"))
    return fragments.join(own.withColumn("median_gap", _middle(F.col("gaps"))), "track_id", "left")


def _middle(values: Column) -> Column:
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def _pair_interval(gap: Column) -> tuple[Column, Column]:
    """The upper median of both tracks' intervals together where it is longer than the time between them, and what it is at most.

    The median of two lists together is no larger than the larger of their medians, so most pairs need no more than these.
    """
    none = F.array().cast("array<long>")
    most = F.greatest("a_median_gap", "b_median_gap")
    both = F.sort_array(F.concat(F.coalesce("a_gaps", none), F.coalesce("b_gaps", none)))
    return F.when(most > gap, _middle(both)).otherwise(most), most


def similarity(a: Column, b: Column) -> Column:
    """The inner product of two descriptors, from 0 to 1; null if one is missing or their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)))


def association_edges(fragments: DataFrame, rule: AssociationPolicy, gaps: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of fragments of an analysis that one player can have left, by time, side, place, speed, size and appearance, with the reasons.

    The speed is over the time between them, or the upper median of both tracks' intervals in `gaps` where that is longer. `appearance` may be a column of
    the fragments: descriptors must not differ much, and after more than a short gap they must be alike and both fragments long enough.

    The range condition 0 < gap <= limit becomes an equi-join: a fragment's end is matched with the starts in its own and the next time bucket,
    so a busy analysis spreads over many tasks; the ends of a bucket are dealt out over SPREAD tasks and meet all of its starts there. Pairs are tested within
    the join, where a track's intervals lie beside it in order: no row per pair and interval is made, and no pair is shuffled.
    """
    pairs, reasons = _pairs(_prepared(fragments, gaps), rule, 0, _limit(rule))
    return pairs.select("analysis_id", "from_track", "to_track", "gap_us", "distance", "area_ratio", "speed", "similarity", reasons.alias("reasons"))


def _limit(rule: AssociationPolicy) -> int:
    return int(rule.max_gap * 1_000_000)


def _prepared(fragments: DataFrame, gaps: DataFrame | None) -> DataFrame:
    if "appearance" not in fragments.columns:
        fragments = fragments.withColumn("appearance", F.lit(None).cast("array<double>"))
    return _with_gaps(fragments.withColumn("us", F.col("last_us") - F.col("first_us")), gaps)


def _pairs(fragments: DataFrame, rule: AssociationPolicy, low: int, high: int, carried: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """The edges of prepared fragments with low < gap <= high, and the column of their reasons. Of a pair also a_ and b_ columns named in `carried`; of
    fragments with `a_meets` and `b_class`, ends meet starts of these classes only."""
    shared = ("track_id", "area", "side", "appearance", "us", "gaps", "median_gap", *carried)
    at = F.floor((F.col("last_us") + low) / (high - low))
    spread = max(1, SPREAD * (high - low) // _limit(rule))  # a narrow range has many buckets
    a = fragments.select("*", F.explode("a_meets").alias("class")) if carried else fragments.withColumn("class", F.lit(0))
    a = a.select("class", F.explode(F.array(at, at + 1)).alias("bucket"), F.pmod(F.hash("track_id"), F.lit(spread)).alias("part"), "analysis_id", *[F.col(c).alias(f"a_{c}") for c in (*shared, "last_us", "last_x", "last_y")])
    b = fragments.withColumn("class", F.col("b_class") if carried else F.lit(0)).where("class IS NOT NULL")
    b = b.select("class", F.floor(F.col("first_us") / (high - low)).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"), "analysis_id", *[F.col(c).alias(f"b_{c}") for c in (*shared, "first_us", "first_x", "first_y")])
    gap = F.col("b_first_us") - F.col("a_last_us")
    across = F.lit(False)
    for one, other in (("NEAR", "FAR"), ("FAR", "NEAR")):
        across |= F.col("a_side").eqNullSafe(one) & F.col("b_side").eqNullSafe(other)
    keys = ["analysis_id", "bucket", "part", "class"]
    tasks = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: fragments are few bytes, their pairs are many rows
    pairs = a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys).where((gap > low) & (gap <= high) & ~across)
    pairs = pairs.withColumns(
        {
            "gap_us": gap,
            "distance": G.distance(F.col("a_last_x"), F.col("a_last_y"), F.col("b_first_x"), F.col("b_first_y")),
            "area_ratio": F.greatest("a_area", "b_area") / F.least("a_area", "b_area"),
            "from_track": F.col("a_track_id"),
            "to_track": F.col("b_track_id"),
        }
    )
    interval, most = _pair_interval(F.col("gap_us"))
    unknown = F.lit(rule.default_interval * 1_000_000)
    speed = lambda v: F.col("distance") / G.seconds(F.greatest(F.col("gap_us").cast("double"), F.coalesce(v, unknown)))
    pairs = pairs.where((F.col("distance") <= rule.endpoint) & (F.col("area_ratio") <= rule.area_ratio) & (speed(most) <= rule.speed))
    pairs = pairs.withColumn("similarity", similarity(F.col("a_appearance"), F.col("b_appearance")))
    alike, short = F.col("similarity"), F.col("gap_us") <= rule.short_gap * 1_000_000
    reentry = F.coalesce(alike >= rule.reentry_appearance, F.lit(False)) & (F.least("a_us", "b_us") >= rule.reentry_duration * 1_000_000)
    pairs = pairs.where(F.coalesce(alike >= rule.appearance, F.lit(True)) & (short | reentry)).withColumn("speed", speed(interval))
    reasons = F.array_compact(F.array(*map(F.lit, EDGE_REASONS), F.when(alike.isNotNull(), "appearance_histogram_consistent"), F.when(~short, "appearance_supported_reentry")))
    return pairs.where(F.col("speed") <= rule.speed), reasons


def _clash(a: Column, b: Column, overlap_us: float) -> Column:
    """Whether members of two groups overlap in time or face each other across the net."""

    def two(x, y):
        sides = ((x["side"] == "NEAR") & (y["side"] == "FAR")) | ((x["side"] == "FAR") & (y["side"] == "NEAR"))
        return F.coalesce(F.least(x["last_us"], y["last_us"]) - F.greatest(x["first_us"], y["first_us"]) > overlap_us, F.lit(False)) | F.coalesce(sides, F.lit(False))

    return F.exists(a, lambda x: F.exists(b, lambda y: two(x, y)))


MOVES = "analysis_id long, old long, new long, first_us array<long>, last_us array<long>, side array<string>"


def _fold(overlap_us: float):
    """Links in their order, joined one after another; the groups that have been joined, with the name and the members they have afterwards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, members = {}, {}
        for pdf in batches:
            names = ("analysis_id", "u", "v", *[f"{s}_{c}" for s in "uv" for c in ("first", "last", "side")])
            for analysis, u, v, *lists in zip(*[pdf[c].tolist() for c in names]):
                for node, own in (((analysis, u), lists[:3]), ((analysis, v), lists[3:])):
                    if node not in group:
                        group[node], members[node] = node, ([node], list(zip(*own)))
                a, b = group[analysis, u], group[analysis, v]
                if a == b or any(min(x[1], y[1]) - max(x[0], y[0]) > overlap_us or {x[2], y[2]} == {"NEAR", "FAR"} for x in members[a][1] for y in members[b][1]):
                    continue
                root, other = min(a, b), max(a, b)
                for node in members[other][0]:
                    group[node] = root
                for held, more in zip(members[root], members.pop(other)):
                    held += more
        lists = {root: [list(x) for x in zip(*own)] for root, (nodes, own) in members.items() if len(nodes) > 1}
        rows = [(c, old, root[1], *lists[root]) for (c, old), root in group.items() if root in lists]
        yield pd.DataFrame(rows, columns=["analysis_id", "old", "new", "first_us", "last_us", "side"])

    return run


def _joined(state: DataFrame, links: DataFrame, overlap_us: float) -> DataFrame:
    """`state` (analysis_id, track_id, group_id) after `links` (analysis_id, u, v, EDGE_ORDER, u_members, v_members) between its groups, in EDGE_ORDER.

    Analyses do not depend on each other, and what comes first of an analysis depends on nothing after it: of each the first FOLD_LINKS links or so, cut between two gaps, are folded
    as a sorted stream. Groups only grow, so a link whose groups clash then is dropped for good, which leaves few for the next round.
    """
    while True:
        links = written(links.where((F.col("u") != F.col("v")) & ~_clash(F.col("u_members"), F.col("v_members"), overlap_us)), "links")
        sizes = links.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("gap_us", [k / CUTS for k in range(1, CUTS + 1)]).alias("at"))
        step = F.greatest(F.lit(1), F.floor(F.lit(CUTS * FOLD_LINKS) / F.col("n"))).cast("int")
        cuts = written(sizes.select("analysis_id", F.when(F.col("n") > FOLD_LINKS, F.element_at("at", F.least(step, F.lit(CUTS)))).alias("cut")), "cuts")
        if cuts.isEmpty():
            return state
        more = not cuts.where("cut IS NOT NULL").isEmpty()
        marked = links.join(cuts, "analysis_id")
        lists = [F.col(f"{s}_members.{c}").alias(f"{s}_{c.split('_')[0]}") for s in "uv" for c in ("first_us", "last_us", "side")]
        first = marked.where("cut IS NULL OR gap_us <= cut").select("analysis_id", "u", "v", *EDGE_ORDER, *lists)
        tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: few bytes, much work
        moves = first.repartition(tasks, "analysis_id").sortWithinPartitions("analysis_id", *EDGE_ORDER).drop(*EDGE_ORDER).mapInPandas(_fold(overlap_us), MOVES)
        moves = written(moves.select("analysis_id", "old", "new", F.arrays_zip("first_us", "last_us", "side").alias("members")), "moves")
        of_track = moves.select("analysis_id", F.col("old").alias("group_id"), "new")
        state = state.join(of_track, ["analysis_id", "group_id"], "left").select("analysis_id", "track_id", F.coalesce("new", "group_id").alias("group_id"))
        state = written(state, "groups")
        if not more:
            return state
        links = marked.where("gap_us > cut").drop("cut")
        for side in ("u", "v"):
            own = moves.select("analysis_id", F.col("old").alias(side), "new", "members")
            links = links.join(own, ["analysis_id", side], "left").withColumns({side: F.coalesce("new", side), f"{side}_members": F.coalesce("members", f"{side}_members")}).drop("new", "members")


def _members(state: DataFrame, fragments: DataFrame) -> DataFrame:
    """`state` with the spans and sides of each group's fragments."""
    rows = state.join(fragments.select("analysis_id", "track_id", F.struct("first_us", "last_us", "side").alias("m")), ["analysis_id", "track_id"])
    return state.join(rows.groupBy("analysis_id", "group_id").agg(F.collect_list("m").alias("members")), ["analysis_id", "group_id"])


def association_groups(fragments: DataFrame, edges: DataFrame, rule: AssociationPolicy = AssociationPolicy()) -> DataFrame:
    """(analysis_id, track_id, group_id): edges taken in EDGE_ORDER join two groups unless any of their fragments overlap in time or face each
    other across the net. Each step depends on those before at the same groups, see _joined."""
    state = fragments.select("analysis_id", "track_id", F.col("track_id").alias("group_id"))
    links = edges.select("analysis_id", *EDGE_ORDER, F.col("from_track").alias("u"), F.col("to_track").alias("v"))
    for side in ("u", "v"):
        own = fragments.select("analysis_id", F.col("track_id").alias(side), F.array(F.struct("first_us", "last_us", "side")).alias(f"{side}_members"))
        links = links.join(own, ["analysis_id", side])
    return _joined(state, links, rule.overlap * 1_000_000)


def grouped_fragments(fragments: DataFrame, rule: AssociationPolicy, gaps: DataFrame | None = None) -> DataFrame:
    """association_groups() of all association_edges(), most of which are never made.

    Edges are taken by their gaps first, so they are made in bands of gaps, each twice as wide as all before, and each band is joined before the next is made. Where a
    group's fragment runs on over all that a band could offer an end or a start, that can only meet fragments too short to overlap (or, without any of these, is left
    out): what has been joined early makes no more pairs, and only edges between groups that do not clash are written.
    """
    conf = fragments.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")  # all is written: a band's shuffles need not outlive it
    try:
        return _banded(fragments, rule, gaps)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _banded(fragments: DataFrame, rule: AssociationPolicy, gaps: DataFrame | None) -> DataFrame:
    overlap_us = rule.overlap * 1_000_000
    held = written(_prepared(fragments, gaps).select("analysis_id", "track_id", "first_us", "last_us", "first_x", "first_y", "last_x", "last_y", "area", "side", "appearance", "us", "gaps", "median_gap"), "fragments")
    state = written(held.select("analysis_id", "track_id", F.col("track_id").alias("group_id")), "groups")
    most = held.groupBy("analysis_id").count().agg(F.max("count")).first()[0] or 0
    short = F.coalesce(F.col("us") <= overlap_us, F.lit(True))
    any_short = not held.where(short).isEmpty()
    limit = _limit(rule)
    ends = [e for e in (limit >> k for k in range(max(0, (most // BAND_FRAGMENTS).bit_length()), -1, -1)) if e > 0]
    for low, high in zip([0, *ends], ends):
        rows = _members(state, held).join(held, ["analysis_id", "track_id"])
        over = lambda start, end, least: F.coalesce(F.exists("members", lambda m: (m["first_us"] <= start) & (m["last_us"] >= end) & least(m)), F.lit(False))
        no_end = over(F.col("last_us") + low, F.col("last_us") + high, lambda m: m["last_us"] - F.col("last_us") - high > overlap_us)
        no_start = over(F.col("first_us") - high, F.col("first_us") - low, lambda m: F.col("first_us") - high - m["first_us"] > overlap_us)
        # classes of starts: 2 if only short ends may meet it, and 1 if it is short itself
        meets = F.filter(F.array(*map(F.lit, range(4))), lambda c: (~no_end | (c % 2 == 1)) & (short | (c < 2)))
        rows = rows.withColumns({"a_meets": meets, "b_class": F.when(no_start, 2).otherwise(0) + F.when(short, 1).otherwise(0)})
        if not any_short:
            rows = rows.withColumns({"a_meets": F.filter("a_meets", lambda c: c == 0), "b_class": F.when(F.col("b_class") == 0, 0)})
        pairs, _ = _pairs(rows, rule, low, high, ("group_id", "members"))
        names = {"a_group_id": "u", "b_group_id": "v", "a_members": "u_members", "b_members": "v_members"}
        state = _joined(state, pairs.select("analysis_id", *EDGE_ORDER, *[F.col(c).alias(n) for c, n in names.items()]), overlap_us)
    return state.select("analysis_id", "track_id", "group_id")


def rollup(obs: DataFrame, membership: DataFrame) -> DataFrame:
    """Per group: distinct frames, tracks, in-court ratio, position span, summed track seconds and quality."""
    rows = obs.join(membership.select("track_id", "group_id"), "track_id")
    inside = lambda c: F.when(F.col("inside"), F.col(c))
    tracks = rows.groupBy("group_id", "track_id").agg(
        (F.max("ts_us") - F.min("ts_us")).alias("us"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("inside").alias("n_in"),
        *[f(inside(c)).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("court_x", "court_y")],
    )
    out = tracks.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("fragments"),
        F.sum("n").alias("observations"),
        (F.sum("n_in") / F.sum("n")).alias("inside_ratio"),
        F.sum("us").alias("us"),
        F.greatest(F.max("max_court_x") - F.min("min_court_x"), F.max("max_court_y") - F.min("min_court_y")).alias("span"),
    )
    strong = (F.col("us") >= 5_000_000) & (F.col("observations") >= 15) & (F.col("inside_ratio") >= 0.65) & (F.col("span") >= 4) & (F.col("fragments") <= 3)
    usable = (F.col("us") >= 1_000_000) & (F.col("observations") >= 3) & (F.col("inside_ratio") >= 0.30)
    quality = F.when(strong, "STRONG").when(usable, "USABLE").otherwise("WEAK")
    return out.select(
        "group_id", "fragments", "observations", F.round("inside_ratio", 6).alias("inside_ratio"), F.round(G.seconds(F.col("us")), 6).alias("seconds"), F.round("span", 6).alias("span"), quality.alias("quality")
    )


def selection(candidates: DataFrame, keys: list[str], top: int) -> DataFrame:
    """`top` candidates per key: the pinned ones first to stay, then by rank (quality, seconds, observations, id), so that a pinned one takes the place of the lowest kept."""
    order = F.when(F.col("quality") == "STRONG", 0).when(F.col("quality") == "USABLE", 1).otherwise(2)
    best = [order, F.desc("seconds"), F.desc("observations"), F.col("group_id")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pinned"), *best))
    return candidates.withColumns({"rank": rank.cast("long"), "__place": place}).where(F.col("__place") <= top).drop("__place")
