"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation and a join on small rows, written to the shared folder; a hub with a third of all edges
is aggregated before the shuffle and its join can be split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import depends, drop, written


def forest(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node of each node's component, for edges within one task."""
    label = np.arange(nodes)
    while True:
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (before == label).all():
            return label


#: A node with at least this share (one of so many) of all edge ends is a hub; there are no more hubs than that.
HUBS = 1024


def _tied(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """edges (u, v) with u's m of least (u, m, n).  Edges of hubs, of which there are at most HUBS, meet a broadcast of
    these and never travel to one task; the others are joined by u."""
    hubs = F.broadcast(least.where(F.col("n") * HUBS >= ends).select("u", F.col("m").alias("hub")))
    known = edges.join(hubs, "u", "left")
    rest = known.where("hub is null").select("u", "v").join(least.where(F.col("n") * HUBS < ends).select("u", "m"), "u")
    return known.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge to another; edges: columns a, b."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: every larger neighbour is tied to the smallest one
        large = _tied(both.where("v > u"), least, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # small star: a node's smaller neighbours and itself are tied to the smallest one
        small = _tied(large, least, now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        fresh = written(small, "edges")
        drop(edges, large)
        edges, last, now = fresh, now, state(fresh)
        if now == last:
            return depends(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), edges)
