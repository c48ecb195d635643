"""Connected components of an edge table by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable. Nodes may be of any type with an order, structs included; a self-loop makes a lone node.

    Each round takes the smallest label among the neighbours and then that label's own label, so the rounds grow with the logarithm of a
    component's diameter. A round's tables are written, so lost executors cost one round at most.
    """
    both = edges.select(F.col(u).alias("node"), F.col(v).alias("other")).unionByName(edges.select(F.col(v).alias("node"), F.col(u).alias("other"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        fresh = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        fresh = fresh.join(above, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        fresh = written(fresh, "labels")
        if fresh.where("label <> old").isEmpty():
            return fresh.select("node", F.col("label").alias("component"))
        labels = fresh.select("node", "label")
