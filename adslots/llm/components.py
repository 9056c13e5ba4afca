"""Connected components by alternating large-star and small-star rounds.

A round joins every edge with the least neighbour of its end, found by a pre-aggregated minimum, so that a node
with very many neighbours is neither collected nor sorted in one task. Rounds go on until the edges no longer
change; every round's edges, and the minima they are joined with, are written to shared storage, so that joins are
between plain shuffles, whose hot nodes Spark can split; they are removed once the next round stands.

Defined cases: edges from a node to itself are no edges, so a node with no other has no row; repeated and reversed
edges count once; no edges, no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); the label is the component's least node."""

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = cut(tidy(edges))
    seen = mark(now)
    while seen[0]:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: the smaller neighbours of a node, and the node, are tied to the least of them
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, now = now, cut(tidy(small))
        for stored in (before, least, large, low):
            drop_cut(stored)
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
