"""Running values along a contig without bringing a contig into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genostrata.operators.scratch import Tables

#: Bases of a contig that one task orders.
SPAN = 1_000_000


def with_running(rows: DataFrame, by: list[str], at: str, order: list[str], value: str, name: str, how: str, *, span: int = SPAN) -> DataFrame:
    """``rows`` with ``name``: the max or the last known ``value`` of the rows before each.

    ``order`` starts with ``at``, a position. Rows are ordered within pieces of ``span``
    bases; what the pieces before hold comes from one row a piece. how: max or last.
    """
    if how not in ("max", "last"):
        raise ValueError(f"unknown kind {how!r}")
    pieces = rows.withColumn("__piece", F.expr(f"{at} div {span}"))
    inner = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    if how == "max":
        whole, near, carried = F.max(value), F.max(value).over(inner), F.max("__whole").over(outer)
    else:
        whole, near, carried = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))), F.last(value, True).over(inner), F.last("__whole", True).over(outer)
    edges = pieces.groupBy(*by, "__piece").agg(whole.alias("__whole")).select(*by, "__piece", carried.alias("__carried"))
    both = F.greatest("__near", "__carried") if how == "max" else F.coalesce("__near", "__carried")
    return pieces.withColumn("__near", near).join(edges, [*by, "__piece"]).withColumn(name, both).drop("__piece", "__near", "__carried")


def with_serial(rows: DataFrame, order: list, name: str, tables: Tables) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... in ``order`` (names or columns), which tells rows apart.

    Rows are dealt to ranges of the order and numbered within them; the numbers go on from
    range to range by the sums of their counts, so no task orders all rows.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    own = [f"__k{i}" for i in range(len(keys))]
    ranged = tables.written(dealt.repartitionByRange(*own).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*own))
    return ranged.withColumn("__place", place).join(starts, "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__before", "__place", *own)
