"""Copy-number segments: run-length collapse, medians, event typing and notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.operators.running import with_running


#: Bins of a contig that one task orders.
BINS = 10_000


def collapse(bins: DataFrame) -> DataFrame:
    """Runs of neighbouring bins of equal call and copy number (to six digits).

    ``bins(chrom, bin, start_pos, end_pos, call, copy_number)``. A run is named by its first
    bin, which is carried along pieces of a contig.
    """
    key = F.struct(F.coalesce("call", F.lit(0.0)).alias("c"), F.bround("copy_number", 6).alias("n"))
    keyed = with_running(bins.withColumn("key", key), ["chrom"], "bin", ["bin"], "key", "before", "last", span=BINS)
    edge = keyed.withColumn("edge", F.when(F.col("before").isNull() | (F.col("before") != F.col("key")), F.col("bin")))
    runs = with_running(edge, ["chrom"], "bin", ["bin"], "edge", "since", "last", span=BINS).withColumn("run", F.coalesce("edge", "since"))
    out = runs.groupBy("chrom", "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("bin_count"), F.median("copy_number").alias("copy_number"), F.median(F.coalesce("call", F.lit(0.0))).alias("call"))
    return out.drop("run")


def weighted_medians(segments: DataFrame) -> DataFrame:
    """(chrom, copy_number): medians with each segment repeated by its width over the least width."""
    width = F.greatest(F.lit(1), F.col("end_pos") - F.col("start_pos"))
    least = F.min(width).over(Window.partitionBy("chrom"))
    times = F.greatest(F.lit(1), F.bround(width / least).cast("int"))
    return segments.withColumn("times", times).groupBy("chrom").agg(F.expr("percentile(copy_number, 0.5, times)").alias("copy_number"))


def consensus(by_bin_size: DataFrame) -> DataFrame:
    """Per chrom over bin sizes: median copy number, its half-even rounding, and how many agree."""
    per = by_bin_size.groupBy("chrom").agg(F.median("copy_number").alias("median_cn"), F.collect_list("copy_number").alias("all"))
    rounded = F.bround("median_cn").cast("int")
    agreeing = F.size(F.filter("all", lambda c: F.bround(c).cast("int") == F.col("rounded_cn"))).cast("long")
    per = per.withColumn("rounded_cn", rounded)
    return per.select("chrom", "median_cn", "rounded_cn", agreeing.alias("agreeing"), F.size("all").cast("long").alias("contributing"), F.array_min("all").alias("min_cn"), F.array_max("all").alias("max_cn"))


def typed_events(segments: DataFrame, contigs: DataFrame, ploidy: float, min_bins: int, whole_fraction: float) -> DataFrame:
    """Events from called segments: gain above the rounded ploidy; whole chromosome by covered share."""
    baseline = round(ploidy)
    rows = segments.where((F.col("bin_count") >= min_bins) & (F.abs("call") >= 1e-12)).join(contigs.select("chrom", "length"), "chrom", "left")
    share = F.coalesce((F.col("end_pos") - F.col("start_pos")) / F.col("length"), F.lit(0.0))
    gain, whole = F.col("copy_number") > baseline, share >= whole_fraction
    kind = F.when(whole & gain, "chromosome_gain").when(whole, "chromosome_loss").when(gain, "duplication").otherwise("deletion")
    exact = F.coalesce((F.col("start_pos") == 0) & (F.col("end_pos") == F.col("length")), F.lit(False))
    return rows.select("chrom", "start_pos", "end_pos", F.greatest(F.lit(0.0), F.col("copy_number")).alias("copy_number"), kind.alias("event_type"), F.round(share, 9).alias("fraction"), (whole & exact).alias("span_confirmed"))


def iscn_fragment(kind: Column, chrom: Column, copy_number: Column, band_start: Column, band_end: Column, confirmed: Column) -> Column:
    """``+8``, ``-7``, ``del(5)(q13q33)``; null outside what can be said safely."""
    name = F.regexp_replace(chrom, "^chr", "")
    pattern = r"^[pq]\d+(\.\d+)?$"
    first, last = F.trim(band_start), F.trim(F.coalesce(band_end, band_start))
    bands = F.when(first == last, first).otherwise(F.concat(first, last))
    prefix = F.when(kind == "deletion", "del").otherwise("dup")
    local = F.concat(prefix, F.lit("("), name, F.lit(")("), bands, F.lit(")"))
    safe = copy_number.isNotNull() & ~name.isin("X", "Y")
    return F.when(safe & (kind == "chromosome_gain") & confirmed, F.concat(F.lit("+"), name)).when(safe & (kind == "chromosome_loss") & confirmed, F.concat(F.lit("-"), name)).when(safe & kind.isin("deletion", "duplication") & first.rlike(pattern) & last.rlike(pattern), local)


def dispositions(fragments: DataFrame, order: list[str]) -> DataFrame:
    """Rows with disposition RENDERED, DUPLICATE (a later equal fragment) or OMITTED (no fragment).

    ``order`` tells rows apart. Only the first row of a fragment is looked for, so however
    many rows share one, none is ranked and no task holds them all.
    """
    firsts = fragments.where("fragment IS NOT NULL").groupBy(F.col("fragment").alias("of")).agg(F.min(F.struct(*order)).alias("first"))
    rows = fragments.join(firsts, F.col("fragment") == F.col("of"), "left")
    state = F.when(F.col("fragment").isNull(), "OMITTED").when(F.struct(*order).eqNullSafe(F.col("first")), "RENDERED").otherwise("DUPLICATE")
    return rows.withColumn("disposition", state).drop("of", "first")
