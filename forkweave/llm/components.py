"""Connected components of links in a shared table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (least, node) of a spanning forest over links between ids a and b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new[label] == label).all():
            break
        label = new[label]
    far = np.flatnonzero(label != np.arange(len(ids)))
    return list(zip(ids[label[far]].tolist(), ids[far].tolist(), strict=True))


def _is_starred(edges: DataFrame) -> bool:
    """Whether every node has one role: the least of its component, or linked to it alone."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionAll(edges.select(F.col("b").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    roles = ends.groupBy("x").agg(F.max("low").alias("low"), F.sum("high").alias("high"))
    return roles.where("high > 1 or (low = 1 and high > 0)").limit(1).count() == 0


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    across = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return across.unionAll(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node that has a link. edges: a, b with a < b.

    Each step joins links with the minimum at one end: a node of many links is a skewed key that a sort-merge join can
    split, and no task collects a node's links. The table of links is written after each round.
    """
    edges = saved(spark, edges.select("a", "b").where("a <> b").distinct(), "links")
    while not _is_starred(edges):
        edges = saved(spark, _small(_large(edges)), "links")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
