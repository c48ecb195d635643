"""Connected components over a table of links, in DataFrame operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, with_group

CHUNK = 1_000_000


def _least_neighbour(pairs: DataFrame, total: int) -> DataFrame:
    """Pairs (u, v), `total` of them, with `low`, the least of u and its v."""
    lows = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("links"))
    return with_group(pairs, lows.select("u", F.least("u", "low").alias("low"), "links"), ["u"], "links", total)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the end of exactly one link or only a centre: then each link names its node's component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("centre"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("centre").alias("centre")).where("n + centre > 1").isEmpty()


def _contracted(batches):
    """The links of each CHUNK rows or so as stars around the least node of what they join: no more links than before, and in memory only one chunk's."""
    held, n = [], 0

    def stars():
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = ends[: len(u)], ends[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, before[a], low)
            np.minimum.at(root, before[b], low)
            root = root[root]
            if (root == before).all():
                break
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"u": nodes[own], "v": nodes[root[own]]})

    for pdf in batches:
        held.append((pdf["u"].to_numpy(), pdf["v"].to_numpy()))
        n += len(pdf)
        if n >= CHUNK:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v): component is the least node that links reach.

    Alternates two steps until the links are stars: every node hands its larger neighbours to its least neighbour, then its smaller ones. Before that, each
    task joins what its own links join. A hub's links are rows, never one group; the rounds grow with the logarithm of the nodes.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = saved(edges.mapInPandas(_contracted, "u long, v long").distinct(), "links")
    while not _are_stars(edges):
        large = _least_neighbour(both(edges), 2 * edges.count()).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        # a node has few smaller neighbours left
        small = large.join(large.groupBy("u").agg(F.min("v").alias("low")).hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v")))
        edges = saved(small.where("u <> v").mapInPandas(_contracted, "u long, v long").distinct(), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
