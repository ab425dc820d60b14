"""Components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genostrata.operators.scratch import Tables


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``edges(a, b)``.

    Labels fall along edges and through pointers (a label takes the label of its own node),
    so the rounds grow with the logarithm of the longest chain; each round is written out.
    """
    with Tables(edges.sparkSession) as tables:
        both = tables.written(edges.select("a", "b").union(edges.select("b", "a").toDF("a", "b")).where("a <> b").distinct())
        labels = tables.written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
        while True:
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("l"))
            lower = labels.join(near, "node").select("node", F.least("label", "l").alias("label"))
            jump = lower.join(labels.toDF("label", "further"), "label").select("node", F.least("label", "further").alias("label"))
            jump = tables.written(jump)
            if jump.join(labels.toDF("node", "old"), "node").where("label <> old").isEmpty():
                return tables.kept(jump.withColumnRenamed("label", "component"))
            labels = jump
