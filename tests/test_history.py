"""The joined record of an analysis, halves of a history, and the pick of a style."""

from pyspark.sql import functions as F

from strideframe.operators import history as H


def test_records_take_what_there_is(spark):
    analyses = spark.createDataFrame([(1, 10, 5.0), (2, 10, None), (3, 10, 7.0)], "analysis_id long, updated_at long, tracked_seconds double")
    analytics = spark.createDataFrame([(1, 20, 3.0)], "analysis_id long, made_at long, observed_seconds double")
    match_iq = spark.createDataFrame([(1, 5, "generated"), (2, 30, "failed")], "analysis_id long, made_at long, status string")
    rows = {r.analysis_id: (r.evaluated_at, r.reliable_seconds, r.measurement_available, r.match_iq_available) for r in H.joined_record(analyses, analytics, match_iq).collect()}
    assert rows == {1: (20, 3.0, True, True), 2: (30, None, False, False), 3: (10, 7.0, False, False)}
    gates = spark.createDataFrame([("CAUTIOUS", "EXCELLENT"), (None, "EXCELLENT"), (None, "UNSUITABLE"), (None, "ODD"), (None, None)], "g string, q string").select(H.system_gate(F.col("g"), F.col("q")).alias("x")).collect()
    assert [r.x for r in gates] == ["CAUTIOUS", "NORMAL", "INSUFFICIENT_EVIDENCE", None, None]


def test_halves_leave_the_middle_out_and_equal_moves_take_the_first_part(spark):
    rows = [(7, k, 100 + k, 1.0, float(a), float(b)) for k, (a, b) in enumerate([(1, 1), (1, 1), (5, 5), (3, 1), (3, 1)])] + [(8, 9, 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "owner long, analysis_id long, at long, seconds double, near double, far double")
    groups = H.comparison_groups(H.even_split(df, ["owner"], "analysis_id", "at"), ["owner"], "at", ["seconds", "near", "far"])
    got = {r.split: (r.period_start, r.period_end, r.analyses, r.analysis_ids, r.near, r.far) for r in groups.collect()}
    assert got == {"earlier": (100, 101, 2, [0, 1], 2.0, 2.0), "recent": (103, 104, 2, [3, 4], 6.0, 2.0)}
    (row,) = H.share_changes(groups, ["owner"], ["near", "far"], 5.0).collect()
    assert (row["style"], round(row.style_change, 6), row.style_status) == ("near", 25.0, "PROVISIONAL_CHANGE")
    (row,) = H.share_changes(groups, ["owner"], ["far", "near"], 30.0).collect()
    assert (row["style"], round(row.style_change, 6), row.style_status) == ("far", -25.0, "NO_CLEAR_CHANGE")
    (row,) = H.share_changes(groups.where("split = 'recent'"), ["owner"], ["far", "near"], 5.0).collect()
    assert (row["style"], row.style_status) == (None, None)
