"""Connected components of large graphs: merging within tasks, then rounds of star operations as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stash, unstash


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with an edge from each node to the least of its component."""
    if not len(a):
        return a, b
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down, and none leads on from a root."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    bad = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down > 1 or (down = 1 and root = 1)")
    return bad.limit(1).count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """edges(a, b) -> node, component: the least node that can be reached. Nodes without edges do not occur.

    Each round attaches every node to the least of its neighbourhood, first
    across its larger neighbours, then its smaller ones; the number of rounds
    grows with the logarithm of the number of nodes. Minima are aggregated
    before they are shuffled, and hub nodes are dealt over salts.
    """
    now = stash(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _is_stars(now):
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "c")
        large = salted_join(now, least, ["v"], total).select("u", F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = salted_join(large, root, ["u"], total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstash(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
