from pyspark.sql import functions as F

from strideframe.operators import invariants as I
from strideframe.operators import reconcile

S = 1_000_000


def test_boxes_name_what_is_wrong_with_them(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0.0, 0.0, 1.0, 1.0), (1, nan, 0.0, 1.0, 1.0), (2, 0.0, 0.0, inf, 1.0), (3, None, 0.0, 1.0, 1.0), (4, 2.0, 2.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double")
    assert {r.k: r.p for r in df.select("k", I.box_problems().alias("p")).collect()} == {0: [], 1: ["NOT_FINITE"], 2: ["NOT_FINITE"], 3: ["NOT_FINITE"], 4: ["NO_WIDTH", "NO_HEIGHT"]}


def test_touching_intervals_do_not_overlap_and_equal_frames_do_not_increase(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 7, 9), (2, 6, 7)], "k long, s long, e long")
    assert [(r.s, r.previous_end) for r in I.overlapping(df, ["k"], "s", "e", []).collect()] == [(7, 8)]
    frames = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (1, 2, 4), (1, 3, 2)], "k long, n long, f long")
    assert sorted((r.n, r.previous) for r in I.not_increasing(frames, ["k"], ["n"], "f").collect()) == [(1, 3), (3, 4)]


def test_merges_that_cannot_be(spark):
    def track(group, frames, x=0.0):
        return [(group, f, f * S, x, 0.0) for f in frames]

    rows = track(1, range(10)) + track(2, range(7, 20)) + track(3, [30], 5.0) + track(4, [60]) + track(5, [31], 500.0) + track(6, [9, *range(40, 60)])
    obs = spark.createDataFrame(rows, "group_id long, frame_index long, ts_us long, court_x double, court_y double")
    pairs = [(1, 2, "NEAR", "NEAR"), (1, 3, "NEAR", "FAR"), (3, 1, "NEAR", "UNKNOWN"), (1, 4, None, "NEAR"), (3, 5, "NEAR", "NEAR"), (1, 6, "NEAR", "NEAR"), (1, 9, "NEAR", "NEAR")]
    pairs = spark.createDataFrame(pairs, "first_id long, second_id long, first_side string, second_side string")
    got = {(r.first_id, r.second_id): (r.shared, r.problem) for r in I.merge_problems(pairs, obs).collect()}
    assert got == {
        (1, 2): (3, "SAME_TIME"), (1, 3): (0, "OPPOSITE_SIDES"), (3, 1): (0, "LONG_GAP"), (1, 4): (0, "LONG_GAP"), (3, 5): (0, "IMPLAUSIBLE_SPEED"), (1, 6): (1, None), (1, 9): (0, "NO_OBSERVATIONS"),
    }


def test_stored_order_decides_who_stays_eligible(spark):
    rows = [(1, k, "STRONG" if k != 1 else "WEAK", 0.9, 1.0, 1) for k in range(7)]
    df = spark.createDataFrame(rows, "a long, k long, quality string, inside_ratio double, movement_rate double, fragments int")
    got = {r.k: (r.eligible, r.reasons) for r in I.stored_selection(df, ["a"], ["k"]).collect()}
    assert [k for k in got if got[k][0]] == [0, 2, 3, 4]
    assert got[1] == (False, ["uncertain_player_candidate"]) and got[5] == (False, ["outside_top_four_court_players"])


def test_actions_on_candidates(spark):
    own = spark.createDataFrame([(1, k, k != 4) for k in range(5)], "a long, k long, eligible boolean")
    actions = [(1, 0, "REJECT", 1), (1, 0, "RESTORE", 2), (1, 1, "SELECT", 3), (1, 2, "SELECT", 4), (1, 3, "REJECT", 5), (1, 4, "RESTORE", 6)]
    schema = "a long, k long, action string, number long"
    status = lambda rows: {r.k: r.status for r in I.selected(own, ["a"], "k", spark.createDataFrame(rows, schema)).collect()}
    assert status(actions) == {0: "PENDING", 1: "PENDING", 2: "SELECTED", 3: "EXCLUDED", 4: "EXCLUDED"}
    cleared = actions + [(1, 2, "REJECT", 7), (1, 2, "RESTORE", 8)]  # restored, but no longer chosen
    assert status(cleared)[2] == "PENDING"


def test_rollups_of_sides_artifacts_and_rows(spark):
    df = spark.createDataFrame([(1, "UNKNOWN", "READY"), (1, "FAR", "LEGACY"), (2, "NEAR", "MISSING"), (2, "FAR", "READY"), (3, "UNKNOWN", "MISSING")], "k long, side string, state string")
    got = {r.k: (r.s, r.a) for r in df.groupBy("k").agg(I.combined_side("side").alias("s"), I.artifact_readiness("state").alias("a")).collect()}
    assert got == {1: ("FAR", "LEGACY"), 2: ("MIXED", "PARTIAL"), 3: ("UNKNOWN", "MISSING")}
    rows = spark.range(7).select(F.lit(1).alias("k"), "id").union(spark.range(2).select(F.lit(2).alias("k"), "id"))
    assert sorted((r.k, r.id) for r in I.first_middle_last(rows, ["k"], ["id"]).collect()) == [(1, 0), (1, 3), (1, 6), (2, 0), (2, 1)]


def test_labels_without_a_document_are_orphans(spark):
    docs = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, v int")
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, v int")
    assert {r.doc_id: r.status for r in reconcile.reconcile(docs, labels, "doc_id", "v").collect()} == {1: "MISSING", 2: "OK", 3: "ORPHAN"}
