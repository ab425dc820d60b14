"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(digest, 20)), F.bit_xor(digest)).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least node reachable from each node of ``edges(a long, b long)``.

    Nodes without an edge are not listed. Loops and repeated edges do no harm; edges with
    a null end are left out. Every round halves the longest chain or better, each round is
    a table of ``scratch``, and minima are combined before any shuffle, so a node with very many
    edges is as good as many nodes with few.
    """
    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.table(large)  # a > b holds in every row
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        edges = scratch.table(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return found.union(edges.select("b", "b").distinct())
