"""Lineage, hash chains, ledgers, run graphs and metric decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genostrata.operators.scratch import Tables


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose key is not null and not in ``parent``."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def chain(rows: DataFrame, by: str, order: str, payload: list[str]) -> DataFrame:
    """seq, digest and prev of an append-only log: each digest covers the payload and its place."""
    seq = F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long")
    out = rows.withColumn("seq", seq)
    out = out.withColumn("digest", F.sha2(F.concat_ws("|", F.col(by).cast("string"), F.col("seq").cast("string"), *[F.col(c).cast("string") for c in payload]), 256))
    return out.withColumn("prev", F.lag("digest").over(Window.partitionBy(by).orderBy("seq")))


def chain_breaks(log: DataFrame, by: str, payload: list[str]) -> DataFrame:
    """(by, seq, fault): gaps of sequence, wrong previous digests and digests that do not fit."""
    order = Window.partitionBy(by).orderBy("seq")
    digest = F.sha2(F.concat_ws("|", F.col(by).cast("string"), F.col("seq").cast("string"), *[F.col(c).cast("string") for c in payload]), 256)
    fault = F.when(F.col("seq") != F.coalesce(F.lag("seq").over(order), F.lit(0)) + 1, "sequence_gap").when(~F.col("prev").eqNullSafe(F.lag("digest").over(order)), "broken_link").when(F.col("digest") != digest, "wrong_digest")
    return log.withColumn("fault", fault).where("fault IS NOT NULL").select(by, "seq", "fault")


def ledger(attempts: DataFrame, key: str, at: str) -> DataFrame:
    """Current state of each key and whether it may be tried again.

    Completed and rejected ones never, locked ones always, failed ones only when asked.
    """
    last = attempts.groupBy(key).agg(F.max_by("state", at).alias("state"), F.count(F.lit(1)).alias("attempts"), F.max(at).alias("last_at"))
    retry = F.when(F.col("state") == "LOCKED", "always").when(F.col("state") == "FAILED", "on_request").otherwise("never")
    return last.withColumn("retry", retry)


def rate_table(runs: DataFrame, by: list[str]) -> DataFrame:
    """Executed lanes and the shares of NO_CALL and FAILED among them, by ``by`` and over all."""
    sums = runs.groupingSets([by, []], *by).agg(F.count(F.lit(1)).alias("lanes"), F.count_if(F.col("state") != "NOT_RUN").alias("executed"), F.count_if(F.col("state") == "NO_CALL").alias("no_call"), F.count_if(F.col("state") == "FAILED").alias("failed"))
    return sums.withColumn("no_call_rate", F.round(F.try_divide("no_call", "executed"), 9)).withColumn("failure_rate", F.round(F.try_divide("failed", "executed"), 9))


def repeat_pairs(rows: DataFrame) -> DataFrame:
    """(grp, left_id, right_id, score): 2 * shared / (left + right) of each pair of repeats in a group.

    ``rows(grp, repeat, item)``. Shared items come from an equi-join on (group, item), so
    pairs of repeats are never formed over all items; both empty gives null.
    """
    sizes = rows.groupBy("grp", "repeat").agg(F.count_distinct("item").alias("n"))
    a, b = sizes.toDF("grp", "left_id", "nl"), sizes.toDF("grp", "right_id", "nr")
    pairs = a.join(b, "grp").where("left_id < right_id")
    x = rows.select("grp", "item", F.col("repeat").alias("left_id")).distinct()
    y = rows.select("grp", "item", F.col("repeat").alias("right_id")).distinct()
    shared = x.join(y, ["grp", "item"]).where("left_id < right_id").groupBy("grp", "left_id", "right_id").agg(F.count(F.lit(1)).alias("s"))
    out = pairs.join(shared, ["grp", "left_id", "right_id"], "left")
    return out.select("grp", "left_id", "right_id", F.round(F.try_divide(2 * F.coalesce("s", F.lit(0)), F.col("nl") + F.col("nr")), 9).alias("score"))


def decisions(questions: DataFrame, metrics: DataFrame, on: str) -> DataFrame:
    """(on, verdict): PASS, FAIL, NO_CALL, NOT_EVALUABLE or NOT_APPLICABLE for each question."""
    q = questions.join(metrics, on, "left")
    verdict = F.when(~F.col("applies"), "NOT_APPLICABLE").when(F.col("no_call_rate") == 1.0, "NO_CALL").when(F.col("value").isNull(), "NOT_EVALUABLE").when(F.col("value") >= F.col("floor"), "PASS").otherwise("FAIL")
    return q.select(on, verdict.alias("verdict"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): longest distance from a root of a graph ``edges(parent, child)``.

    Walks the graph one step at a time, so depth does not matter; edges with a null end are
    left out. A cycle raises ValueError. The result is a written table.
    """
    with Tables(edges.sparkSession) as tables:
        steps = tables.written(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct())
        every = tables.written(nodes.select("node").where("node IS NOT NULL").distinct())
        front = tables.written(every.join(steps.select(F.col("child").alias("node")).distinct(), "node", "left_anti"))
        most, depth, seen = every.count(), 0, []
        while not front.isEmpty():
            if depth >= most:
                raise ValueError("the graph has a cycle")
            seen.append(front.withColumn("level", F.lit(depth)))
            front = tables.written(front.join(steps, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct())
            depth += 1
            if len(seen) == 50:  # keep the plan of the union short
                seen = [tables.written(reduce(DataFrame.unionByName, seen).groupBy("node").agg(F.max("level").alias("level")))]
        if not seen:
            if most:
                raise ValueError("the graph has a cycle")
            return tables.kept(every.withColumn("level", F.lit(0)))
        out = tables.kept(reduce(DataFrame.unionByName, seen).groupBy("node").agg(F.max("level").alias("level")))
        if not every.join(out, "node", "left_anti").isEmpty():
            raise ValueError("the graph has a cycle")
        return out


def blocked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, state): nodes below one that did not finish become NOT_RUN, never FAILED.

    ``nodes(node, outcome)``; COMPLETED and NO_CALL count as finished. Null ends of edges
    are left out; cycles do no harm. The result is a written table.
    """
    with Tables(edges.sparkSession) as tables:
        steps = tables.written(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct())
        bad = nodes.where("outcome NOT IN ('COMPLETED', 'NO_CALL')").select("node")
        down = front = tables.written(bad.join(steps, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct())
        while not front.isEmpty():
            front = tables.written(front.join(steps, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().join(down, "node", "left_anti"))
            down = tables.written(down.unionByName(front))
        out = nodes.join(down.withColumn("below", F.lit(True)), "node", "left")
        return tables.kept(out.select("node", F.when(F.col("below"), "NOT_RUN").otherwise(F.col("outcome")).alias("state")))
