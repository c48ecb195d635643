"""Findings of round 3: what went wrong only on larger tables, in small."""

import random

from pyspark.sql import functions as F

from strideframe.functions import scalars
from strideframe.operators import association, evaluation
from strideframe.plans.decision_queries import name_scalars
from strideframe.plans.policy import AssociationPolicy


def test_f3_names_of_orders_whose_cube_is_no_long(spark, tmp_path):
    spark.createDataFrame([(5_000_001, "1-URGENT"), (3, "5-LOW")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.k: r.size for r in name_scalars(spark, str(tmp_path)).collect()}
    assert got == {5_000_001: f"{5_000_001**3 / 2**30:.2f} GB", 3: "27 B"}


def test_f3_sizes_are_rounded_as_binary_numbers(spark):
    size = spark.range(1).select(scalars.size_text(F.lit(961857**3)).alias("t")).first().t
    assert size == "828765492.46 GB"


def test_f4_percentages_at_a_tie_are_rounded_as_the_engine_of_the_statement_does(spark):
    rows = spark.createDataFrame([(9.0, 2000.0), (37.0, 2000.0), (143.0, 2000.0), (1.0, 3.0)], "a double, w double")
    rate = evaluation.duration_rate(F.col("a"), F.col("w"), F.lit(9), F.lit(False))
    assert [r.t.split("(")[1].split("%")[0] for r in rows.select(rate["text"].alias("t")).collect()] == ["0.5", "1.9", "7.2", "33.3"]


def test_f1_the_interval_of_both_tracks_takes_no_row_per_pair_and_value(spark):
    rng = random.Random(1)
    own = [(t, 0, 0, t * 10, t * 10 + 5, 0.0, 0.0, 0.001, 0.0, 1.0, "NEAR") for t in range(40)]
    fragments = spark.createDataFrame(own, "track_id long, player_id long, analysis_id long, first_us long, last_us long, first_x double, first_y double, last_x double, last_y double, area double, side string")
    values = {t: sorted(rng.randrange(1, 1000) for _ in range(rng.randrange(6))) for t in range(40)}
    gaps = spark.createDataFrame([(t, v) for t, vs in values.items() for v in vs], "track_id long, gap_us long")
    edges = association.association_edges(fragments, AssociationPolicy(speed=1e6), gaps)
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            both = sorted(values[a] + values[b])
            want[a, b] = 0.001 / (max((b - a) * 10 - 5, both[len(both) // 2] if both else 1e6 / 30) / 1e6)
    got = {(r.from_track, r.to_track): r.speed for r in edges.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * want[k] for k in want)
    assert "Window" not in edges._jdf.queryExecution().optimizedPlan().toString()
