"""Coverage of target regions, and checks of region and contig sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genostrata.operators.rangejoin import merged_intervals, overlap_join
from genostrata.operators.running import with_running
from genostrata.operators.tiles import TILE, overlap_totals


def summary(targets: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Per chrom: interval-weighted mean, exact min, median, max, and share of bases at each depth."""
    t = targets.withColumn("len", F.col("end_pos") - F.col("start_pos"))
    shares = [F.round(F.sum(F.when(F.col("mean_depth") >= x, F.col("len")).otherwise(0)) / F.sum("len"), 6).alias(f"share_{x}x") for x in thresholds]
    weighted = F.sum(F.col("mean_depth") * F.col("len")) / F.sum("len")
    return t.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("len").alias("target_bp"), F.round(weighted, 6).alias("weighted_mean"), F.round(F.min("mean_depth"), 6).alias("min_depth"), F.round(F.median("mean_depth"), 6).alias("median_depth"), F.round(F.max("mean_depth"), 6).alias("max_depth"), *shares)


def overlapping(targets: DataFrame) -> DataFrame:
    """Per chrom: regions that start before the furthest end of those before them."""
    rows = with_running(targets, ["chrom"], "start_pos", ["start_pos", "end_pos", "target_id"], "end_pos", "reach", "max")
    return rows.withColumn("hit", F.col("start_pos") < F.col("reach")).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_targets"), F.count_if("hit").alias("n_overlapping"))


def overlaps_by_label(calls: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, label, n_calls, most, overlap_bp, depth) of regions and labels that share a base.

    ``calls(l_chrom, l_start, l_end, label, value)`` and ``regions(r_chrom, r_start, r_end, mean_depth, *keys)``. What is
    longer than a tile is joined; all else comes from sums within tiles, not from pairs.
    """
    wide_regions, wide_calls = regions.where(f"r_end - r_start > {TILE}"), calls.where(f"l_end - l_start > {TILE}")
    short = regions.where(f"r_end - r_start <= {TILE}")
    rows = overlap_totals(calls.where(f"l_end - l_start <= {TILE}"), short)
    for some, over in ((calls, wide_regions), (wide_calls, short)):
        if not (wide_regions if some is calls else wide_calls).isEmpty():
            shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
            rows = rows.unionByName(overlap_join(some, over).select(*regions.columns, "label", F.lit(1).cast("long").alias("n"), F.col("value").cast("long").alias("most"), shared.alias("overlap_bp")))
    return rows.groupBy(*keys, "label").agg(F.sum("n").alias("n_calls"), F.max("most").alias("most"), F.sum("overlap_bp").alias("overlap_bp"), F.max("mean_depth").alias("depth"))


def thresholds_long(wide: DataFrame, key: str) -> DataFrame:
    """(key, threshold, bases) from columns named ``<depth>X``."""
    names = [c for c in wide.columns if c != key]
    long = wide.unpivot([key], names, "name", "bases")
    return long.select(key, F.regexp_replace("name", "X$", "").cast("int").alias("threshold"), "bases")


def breakpoints(events: DataFrame) -> DataFrame:
    """(event_id, k, l_chrom, l_start, l_end): the loci whose coverage bears an event.

    Deletions, duplications and inversions have two points (start, end - 1), insertions
    one, paired events (chrom2, start2, end2 where ``events`` has them) both loci whole, and
    anything else its locus.
    """
    locus = lambda c, s, e: F.struct(F.col(c).alias("l_chrom"), s.cast("long").alias("l_start"), e.cast("long").alias("l_end"))
    point = lambda p: locus("chrom", p, p + 1)
    start, end = F.col("start_pos"), F.col("end_pos")
    loci = F.when(F.col("event_type").isin("deletion", "duplication", "inversion"), F.array(point(start), point(end - 1))).when(F.col("event_type") == "insertion", F.array(point(start))).otherwise(F.array(locus("chrom", start, end)))
    if "chrom2" in events.columns:
        loci = F.when(F.col("chrom2").isNotNull(), F.array(locus("chrom", start, end), locus("chrom2", F.col("start2"), F.col("end2")))).otherwise(loci)
    return events.select("event_id", F.posexplode(loci).alias("k", "l")).select("event_id", "k", "l.*").distinct()


def observability(events: DataFrame, targets: DataFrame, min_depth: float, *, assessed: bool = True, buffered: bool = False) -> DataFrame:
    """(event_id, n_points, observability): whether an event's breakpoints lie in regions of enough depth.

    Outside only if no locus is in a region, partially observed if some are; a locus in
    several regions takes the deepest. With ``buffered`` regions (a panel widened on either
    side) the best that can be said is partially observed. Without ``assessed`` (an assay
    that selects nothing) the question does not apply.
    """
    sites = breakpoints(events)
    if not assessed:
        return sites.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_points")).withColumn("observability", F.lit("not_applicable"))
    regions = targets.where("mean_depth IS NOT NULL").select(F.col("chrom").alias("r_chrom"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), (F.col("mean_depth") >= min_depth).alias("enough"))
    # Only whether some region is over a locus and whether a deep one is matters, so regions of a kind are merged.
    regions = merged_intervals(regions, ["enough"])
    place = ["event_id", "k", "l_chrom", "l_start", "l_end"]
    deep = overlap_join(sites, regions).groupBy(*place).agg(F.max("enough").alias("enough"))
    all_points = sites.join(deep, place, "left")
    inside = F.col("enough").isNotNull()
    best = "partially_observed" if buffered else "observed_adequately"
    state = F.when(~F.bool_or(inside), "outside_target").when(~F.bool_and(inside), "partially_observed").when(F.bool_and("enough"), best).otherwise("insufficient_coverage")
    return all_points.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_points"), state.alias("observability"))


def set_difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(side, n): rows missing from ``found``, unexpected in it, and distinct common ones."""
    sides = {"missing": expected.exceptAll(found), "unexpected": found.exceptAll(expected), "common": expected.intersect(found)}
    out = None
    for side, rows in sides.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def dictionary_check(lock: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of contigs missing, extra and of another length than in the lock."""
    a, b = lock.toDF("a", "la"), found.toDF("b", "lb")
    both = a.join(b, F.col("a") == F.col("b"), "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_extra"), F.count_if(F.col("la") != F.col("lb")).alias("n_length_mismatch"))
