"""Findings of round 4."""

import re

import numpy as np
import pandas as pd
from pyspark import TaskContext

from strideframe.llm import toxicity as T
from strideframe.operators import association as J
from strideframe.plans.policy import AssociationPolicy


def _shards(spark, tmp_path, n):
    rows = pd.DataFrame({"shard": range(n)} | {c: [b""] * n for c in ("toxic", "lang", "held", "counts", "words")})
    path = str(tmp_path / "shards")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        spark.createDataFrame(rows, T.SHARD).repartition(n).write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    return spark.read.schema(T.SHARD).parquet(path)


def test_f1_and_f2_tasks_that_learn_do_not_grow_with_the_shards(spark, tmp_path):
    shards = _shards(spark, tmp_path, 40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = T._gathered(shards, lambda shard: [("task", np.array([TaskContext.get().partitionId()]), np.ones((1, 1), np.int64))])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    places, n = got["task"]
    assert n.sum() == 40 and len(places) <= 2 * spark.sparkContext.defaultParallelism + 1


def test_f1_and_f2_sums_and_means_over_shards_are_exact(spark, tmp_path):
    shards = _shards(spark, tmp_path, 9)
    found = lambda shard: [("a", np.array([shard["shard"], 5000]), np.array([[3 << 32, 1], [shard["shard"] << 32, 1]])), ("none", np.zeros(0, np.int64), np.zeros((0, 2), np.int64))]
    (places, total), (_, mean) = T._gathered(shards, found)["a"], T._gathered(shards, found, mean=True)["a"]
    assert places.tolist() == [*range(9), 5000]
    assert total.tolist() == [[3 << 32, 1]] * 9 + [[36 << 32, 9]] and mean.tolist() == [[3.0]] * 9 + [[4.0]]


def test_f3_links_that_depend_on_each_other_need_no_round_each(spark, monkeypatch):
    n, names = 30, []
    fragments = spark.createDataFrame([(0, t, 10 * t, 10 * t + 5, "UNKNOWN") for t in range(n + 1)], "analysis_id long, track_id long, first_us long, last_us long, side string")
    edges = spark.createDataFrame([(0, 100 + t, 1.0, 1.0, t, t + 1) for t in range(n)], "analysis_id long, gap_us long, distance double, area_ratio double, from_track long, to_track long")
    written = J.written
    monkeypatch.setattr(J, "written", lambda df, name: names.append(name) or written(df, name))
    monkeypatch.setattr(J, "FOLD_LINKS", 10)
    got = J.association_groups(fragments, edges).collect()
    assert len(got) == n + 1 and {r.group_id for r in got} == {0} and names.count("links") <= 5


def test_f5_few_copies_of_a_fragment_are_shuffled(spark):
    columns = "track_id long, analysis_id long, first_us long, last_us long, first_x double, first_y double, last_x double, last_y double, area double, side string"
    plan = J.association_edges(spark.createDataFrame([], columns), AssociationPolicy())._jdf.queryExecution().analyzed().toString()
    copies = [int(hi) + 1 for hi in re.findall(r"explode\(sequence\(0, (\d+)", plan)]
    assert copies and max(copies) <= 4
