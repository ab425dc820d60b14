"""Interval joins on (contig, coordinate bin).

A join on overlap alone is a cartesian product, and one on the contig leaves the overlap as
a residual condition over whole contigs. Here each interval is posted under the bins it
touches, so that candidates are those within a bin; a pair is taken from the bin in which
the later of the two starts lies, so none comes twice and no distinct is needed. Intervals
of either side have a level by their own length, at which they touch a bounded number of
bins; a pair meets at the coarser one of its two levels, where both touch few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genostrata.operators.running import with_running

BIN = 20_000
#: Finest bins of joins with points: narrower, as only intervals are posted under several, and fewer pairs miss.
POINT_BIN = 8192
#: Levels of bins, each so many times wider than the one before.
LEVELS, FACTOR = 4, 32


def interval_level(length: Column, width: int = BIN) -> Column:
    """The finest level at which an interval touches at most FACTOR + 1 bins."""
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(length <= width * FACTOR ** (i + 1), i).otherwise(level)
    return level


def overlap_join(left: DataFrame, right: DataFrame, *, width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of rows with l_start < r_end and r_start < l_end on one contig.

    ``left`` has l_chrom, l_start, l_end and ``right`` r_chrom, r_start, r_end (half-open,
    not empty), with any other, different columns. Null or empty intervals match nothing.
    how: inner, left_semi or left_anti.
    """
    if how != "inner":
        keyed = left.withColumn("__rid", F.struct(*left.columns))
        hit = overlap_join(left, right, width=width).select(F.struct(*left.columns).alias("__hit")).distinct()
        return keyed.join(hit, F.col("__rid").eqNullSafe(F.col("__hit")), how).drop("__rid")
    l, r = _levelled(left, right, width)
    # Each pair of own levels meets at the greater one, and only there.
    on = (F.col("l_chrom") == F.col("r_chrom")) & (l["__at"] == r["__at"]) & (l["__bin"] == r["__bin"]) & (l["__at"] == F.greatest(l["__own"], r["__own"]))
    met = l.join(r, on).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    later = F.greatest("l_start", "r_start")
    return met.where((later >= l["__bin"] * l["__w"]) & (later < (l["__bin"] + 1) * l["__w"])).select(*left.columns, *right.columns)


def _levelled(left: DataFrame, right: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Both sides under their bins, at the levels where they can meet."""
    l, r = (  # noqa: E741
        side.where(f"{c}_start < {c}_end").withColumn("__own", interval_level(F.col(f"{c}_end") - F.col(f"{c}_start"), width))
        for side, c in ((left, "l"), (right, "r"))
    )
    # Only levels that the other side has: as a rule one, so rows are not copied for the others.
    present = lambda side: side.agg(F.array_sort(F.collect_set("__own")).alias("levels")).scalar()
    return _posted(l, "l", present(r), width), _posted(r, "r", present(l), width)


def _posted(rows: DataFrame, side: str, others: Column, width: int) -> DataFrame:
    """``rows`` under their bins at their own level and at each coarser one that the other side has."""
    coarser = F.array_distinct(F.transform("__others", lambda i: F.greatest(i, F.col("__own"))))
    at = rows.withColumn("__others", others).withColumn("__at", F.explode(coarser)).withColumn("__w", (F.lit(width) * F.pow(F.lit(FACTOR), F.col("__at"))).cast("long"))
    return at.withColumn("__bin", F.explode(F.sequence(F.expr(f"{side}_start div __w"), F.expr(f"({side}_end - 1) div __w"))))


def overlap_exists(left: DataFrame, right: DataFrame, condition: Column, key: str, *, width: int = BIN) -> DataFrame:
    """The distinct ``key`` of the rows of ``left`` that some overlapping row of ``right`` meets with ``condition``.

    Columns are as for ``overlap_join``. A row is done with its first hit in a bin, so pairs
    are neither kept nor shuffled.
    """
    l, r = _levelled(left, right, width)
    on = (F.col("l_chrom") == F.col("r_chrom")) & (l["__at"] == r["__at"]) & (l["__bin"] == r["__bin"]) & (l["__at"] == F.greatest(l["__own"], r["__own"]))
    return l.join(r, on & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & condition, "left_semi").select(key).distinct()


def merged_intervals(intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(r_chrom, r_start, r_end, *by): the stretches that the intervals of equal ``by`` cover, none touching another.

    What meets an interval meets its stretch and the reverse, while a point lies in one
    stretch at most, however many intervals lie over each other. Empty intervals cover nothing.
    """
    by = by or []
    rows = intervals.where("r_chrom IS NOT NULL AND r_start < r_end").select(F.struct("r_chrom", *by).alias("__by"), "r_start", "r_end").distinct()
    rows = with_running(rows, ["__by"], "r_start", ["r_start", "r_end"], "r_end", "__reach", "max")
    rows = rows.withColumn("__first", F.when(F.coalesce(F.col("r_start") > F.col("__reach"), F.lit(True)), F.col("r_start")))
    rows = with_running(rows, ["__by"], "r_start", ["r_start", "r_end"], "__first", "__open", "last")
    whole = rows.groupBy("__by", F.coalesce("__first", "__open").alias("r_start")).agg(F.max("r_end").alias("r_end"))
    return whole.select("__by.r_chrom", "r_start", "r_end", *[F.col("__by")[c].alias(c) for c in by])


def point_join(points: DataFrame, intervals: DataFrame, *, width: int = POINT_BIN) -> DataFrame:
    """All intervals (r_chrom, r_start, r_end) that hold a point (l_chrom, l_pos): nested hits too.

    A point lies in one bin of each level, so pairs meet at the interval's level, once, and
    only the two comparisons are left to be made for each.
    """
    spans = intervals.where("r_chrom IS NOT NULL AND r_start < r_end").withColumn("__at", interval_level(F.col("r_end") - F.col("r_start"), width))
    levels = spans.agg(F.array_sort(F.collect_set("__at"))).scalar()
    size = F.expr(f"bigint({width} * power({FACTOR}, __at))")
    r = spans.withColumn("__w", size).withColumn("__bin", F.explode(F.expr("sequence(r_start div __w, (r_end - 1) div __w)")))
    l = points.where("l_chrom IS NOT NULL AND l_pos IS NOT NULL").withColumn("__at", F.explode(levels)).withColumn("__w", size).withColumn("__bin", F.expr("l_pos div __w"))  # noqa: E741

    def keyed(rows: DataFrame, side: str, names: list[str]) -> DataFrame:
        # Level and bin are one number, and a hash of contig and number comes first: sorting then compares numbers.
        rows = rows.withColumn("__place", F.col("__bin") * LEVELS + F.col("__at"))
        return rows.select(*names, F.col("__place").alias(f"__{side}_place"), F.xxhash64(f"{side}_chrom", "__place").alias(f"__{side}_key"))

    on = (F.col("__l_key") == F.col("__r_key")) & (F.col("__l_place") == F.col("__r_place")) & (F.col("l_chrom") == F.col("r_chrom"))
    met = keyed(l, "l", points.columns).join(keyed(r, "r", intervals.columns), on & (F.col("l_pos") >= F.col("r_start")) & (F.col("l_pos") < F.col("r_end")))
    return met.select(*points.columns, *intervals.columns)


def nearest(points: DataFrame, intervals: DataFrame, *, span: int = 1_000_000) -> DataFrame:
    """For each l_id the interval at least distance, by (distance, start, end, label).

    Distance is 0 on overlap, else the smaller of abs(l_start - r_end) and
    abs(r_start - l_end). The nearest on either side comes from as-of windows over the
    contig cut into pieces of ``span``, with the last end and first start of the pieces
    beyond carried over, so no contig is gathered whole with a join of all pairs.
    """
    # Of the intervals over a place the first in order is the first that ends beyond the place's start, if it
    # begins in time; it ends further than all before it, and of such intervals start and end grow together.
    order = ["r_start", "r_end", "r_label"]
    ordered = with_running(intervals.where("r_start < r_end").withColumn("__by", F.col("r_chrom")).select("__by", "r_chrom", *order), ["__by"], "r_start", order, "r_end", "__reach", "max")
    furthest = ordered.where("__reach IS NULL OR r_end > __reach").groupBy("r_chrom", "r_end").agg(F.min(F.struct("r_start", "r_label")).alias("m"))
    furthest = furthest.select("r_chrom", (F.col("r_end") - 1).alias("at"), F.struct("m.r_start", "r_end", "m.r_label").alias("v"))
    piece = lambda c: F.expr(f"{c} div {span}")
    # To the left, the interval of greatest end (then least start, label); to the right, of least start (then end, label).
    lefts = intervals.groupBy("r_chrom", "r_end").agg(F.min(F.struct("r_start", "r_label")).alias("m")).select("r_chrom", F.col("r_end").alias("at"), F.struct("m.r_start", "r_end", "m.r_label").alias("v"))
    rights = intervals.groupBy("r_chrom", "r_start").agg(F.min(F.struct("r_end", "r_label")).alias("m")).select("r_chrom", F.col("r_start").alias("at"), F.struct("r_start", "m.r_end", "m.r_label").alias("v"))

    def asof(sites: DataFrame, rows: DataFrame, side: str, backward: bool) -> DataFrame:
        from pyspark.sql import Window

        one = sites.select(F.col("l_chrom").alias("c"), F.col(side).alias("at"), "l_id", "l_start", "l_end", F.lit(None).cast(rows.schema["v"].dataType).alias("v"))
        two = rows.select(F.col("r_chrom").alias("c"), "at", *(F.lit(None).cast(sites.schema[k].dataType).alias(k) for k in ("l_id", "l_start", "l_end")), "v")
        both = one.unionByName(two).withColumn("piece", piece("at"))
        bounds = rows.withColumn("piece", piece("at")).groupBy(F.col("r_chrom").alias("c"), "piece").agg((F.max_by if backward else F.min_by)("v", "at").alias("edge"))
        order = F.col("piece") if backward else F.col("piece").desc()
        beyond = Window.partitionBy("c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        pieces = both.select("c", "piece").distinct().join(bounds, ["c", "piece"], "left").withColumn("carried", F.last("edge", True).over(beyond)).drop("edge")
        place = F.col("at") if backward else F.col("at").desc()
        near = Window.partitionBy("c", "piece").orderBy(place, F.col("l_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("w", F.last("v", True).over(near)).where("l_id IS NOT NULL").join(pieces, ["c", "piece"])
        found = found.withColumn("v", F.coalesce("w", "carried")).where("v IS NOT NULL")
        if rows is furthest:
            return found.where("v.r_start < l_end").select("l_id", F.lit(0).cast("long").alias("distance"), "v.r_start", "v.r_end", "v.r_label")
        return found.select("l_id", F.least(F.abs(F.col("l_start") - F.col("v.r_end")), F.abs(F.col("v.r_start") - F.col("l_end"))).alias("distance"), "v.r_start", "v.r_end", "v.r_label")

    options = reduce(DataFrame.unionByName, [asof(points.where("l_start < l_end"), furthest, "l_start", False), asof(points, lefts, "l_start", True), asof(points, rights, "l_end", False)])
    best = options.groupBy("l_id").agg(F.min(F.struct("distance", "r_start", "r_end", "r_label")).alias("b"))
    return best.select("l_id", "b.distance", "b.r_start", "b.r_end", "b.r_label")
