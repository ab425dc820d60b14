"""Annotation joins: transcripts, exons, cytobands, gene sets and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.operators.rangejoin import merged_intervals, overlap_join, point_join


def transcript_tier(mane: Column, canonical: Column, appris: Column, kind: Column, basic: Column) -> Column:
    """0 MANE Select, 1 MANE Plus Clinical, 2 canonical or APPRIS principal, 3 coding or basic, 4 other."""
    principal = F.coalesce(canonical, F.lit(False)) | F.lower(F.coalesce(appris, F.lit(""))).startswith("appris_principal")
    return F.when(mane == "MANE Select", 0).when(mane == "MANE Plus Clinical", 1).when(principal, 2).when((kind == "protein_coding") | F.coalesce(basic, F.lit(False)), 3).otherwise(4)


def ranked_transcripts(transcripts: DataFrame) -> DataFrame:
    """Transcripts with tier, rank within the gene and preferred (rank 1)."""
    tier = transcript_tier(F.col("mane_status"), F.col("is_canonical"), F.col("appris"), F.col("transcript_type"), F.col("is_basic"))
    order = Window.partitionBy("gene_id").orderBy("tier", F.desc("cds_length"), F.desc("transcript_length"), "transcript_id")
    out = transcripts.withColumn("tier", tier).withColumn("rank", F.row_number().over(order).cast("long"))
    return out.withColumn("preferred", F.col("rank") == 1)


def exon_or_intron(points: DataFrame, exons: DataFrame) -> DataFrame:
    """(point_id, transcript_id, part, number) for points (l_chrom, l_pos) in transcripts.

    The first exon by number that holds the point; else the gap between exons of following
    numbers, named by the lesser number, whatever the strand; else ``transcript``.
    """
    order = Window.partitionBy("transcript_id").orderBy("exon_number", "start_pos", "end_pos")
    nxt = exons.withColumn("n2", F.lead("exon_number").over(order)).withColumn("s2", F.lead("start_pos").over(order)).withColumn("e2", F.lead("end_pos").over(order))
    gaps = nxt.where("n2 IS NOT NULL").select("chrom", "transcript_id", F.least("end_pos", "e2").alias("r_start"), F.greatest("start_pos", "s2").alias("r_end"), F.lit(1).alias("kind"), F.least("exon_number", "n2").alias("number")).where("r_start < r_end")
    own = exons.select("chrom", "transcript_id", F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), F.lit(0).alias("kind"), F.col("exon_number").alias("number"))
    span = exons.groupBy("chrom", "transcript_id").agg(F.min("start_pos").alias("r_start"), F.max("end_pos").alias("r_end")).select("chrom", "transcript_id", "r_start", "r_end", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("number"))
    parts = own.unionByName(gaps).unionByName(span).withColumnRenamed("chrom", "r_chrom").where("r_start < r_end")
    # A transcript is cut where its parts begin and end, and each piece has the first part over it: a point meets one
    # piece of a transcript, so only ids that stand in several points are grouped, and pairs are not shuffled.
    own = ["r_chrom", "transcript_id"]
    edges = parts.select(*own, F.explode(F.array("r_start", "r_end")).alias("at")).distinct()
    pieces = edges.withColumn("to", F.lead("at").over(Window.partitionBy(*own).orderBy("at"))).where("to IS NOT NULL")
    over = parts.select(F.col("r_chrom").alias("c"), F.col("transcript_id").alias("t"), "r_start", "r_end", "kind", "number")
    covered = pieces.join(over, (F.col("r_chrom") == F.col("c")) & F.col("transcript_id").eqNullSafe(F.col("t")) & (F.col("r_start") <= F.col("at")) & (F.col("to") <= F.col("r_end")))
    covered = covered.groupBy(*own, F.col("at").alias("r_start"), F.col("to").alias("r_end")).agg(F.min(F.struct("kind", "number")).alias("b"))
    sized = points.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("point_id")))
    met = point_join(sized, covered).select("point_id", "transcript_id", "__n", "b")
    again = met.where("__n > 1").groupBy("point_id", "transcript_id").agg(F.min("b").alias("b"))
    best = met.where("__n = 1").drop("__n").unionByName(again)
    part = F.when(F.col("b.kind") == 0, "exon").when(F.col("b.kind") == 1, "intron").otherwise("transcript")
    return best.select("point_id", "transcript_id", part.alias("part"), F.col("b.number").alias("number"))


def band_overlaps(segments: DataFrame, bands: DataFrame, affected_fraction: float) -> DataFrame:
    """(event_id, chrom, direction, band, band_index, overlap_bp, fraction, affected) of every overlap."""
    order = Window.partitionBy("chrom").orderBy("start_pos", "end_pos", "band")
    indexed = bands.withColumn("band_index", F.row_number().over(order).cast("long"))
    left = segments.select(F.col("chrom").alias("l_chrom"), F.col("start_pos").alias("l_start"), F.col("end_pos").alias("l_end"), "event_id", "direction")
    right = indexed.select(F.col("chrom").alias("r_chrom"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), "band", "band_index")
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    met = overlap_join(left, right).withColumn("overlap_bp", shared).withColumn("fraction", F.col("overlap_bp") / (F.col("r_end") - F.col("r_start")))
    return met.select("event_id", F.col("l_chrom").alias("chrom"), "direction", "band", "band_index", "overlap_bp", "fraction", (F.col("fraction") >= affected_fraction).alias("affected"))


def band_groups(overlaps: DataFrame) -> DataFrame:
    """Runs of affected bands of following index: (chrom, direction, first_index, last_index, n_bands)."""
    hit = overlaps.where("affected").select("chrom", "direction", "band_index").distinct()
    order = Window.partitionBy("chrom", "direction").orderBy("band_index")
    island = hit.withColumn("island", F.col("band_index") - F.row_number().over(order))
    return island.groupBy("chrom", "direction", "island").agg(F.min("band_index").alias("first_index"), F.max("band_index").alias("last_index"), F.count(F.lit(1)).alias("n_bands")).drop("island")


def gene_set_matches(events: DataFrame, records: DataFrame) -> DataFrame:
    """(event_id, record_id, rule): knowledge records whose genes an event has, case-insensitively.

    ``events(event_id, genes)``, ``records(record_id, pattern_type, genes)``. An exact pair
    needs all genes of the record; gene_any_partner needs them in an event of two genes or
    more. Records meet events through their first gene, so no pair is formed without one.
    """
    up = lambda c: F.array_distinct(F.transform(c, lambda g: F.upper(g)))
    e = events.select("event_id", up(F.col("genes")).alias("have"))
    r = records.select("record_id", "pattern_type", up(F.col("genes")).alias("need")).where(F.size("need") > 0).withColumn("key", F.get("need", F.lit(0)))
    met = e.withColumn("key", F.explode("have")).join(r, "key").where(F.size(F.array_except("need", "have")) == 0)
    met = met.where((F.col("pattern_type") == "exact_pair") | (F.size("have") >= 2))
    return met.select("event_id", "record_id", F.col("pattern_type").alias("rule"))


def panel_reach(criteria: DataFrame, panel: DataFrame) -> DataFrame:
    """(record_id, status, present, missing) of criteria against the genes of a panel.

    ``criteria(record_id, needs_small_variants, genes)``, ``panel(gene)``.
    """
    genes = criteria.select("record_id", F.explode("genes").alias("gene"))
    p = panel.select("gene").distinct().withColumn("here", F.lit(True))
    per = genes.join(p, "gene", "left").groupBy("record_id").agg(F.array_sort(F.collect_set(F.when(F.col("here"), F.col("gene")))).alias("present"), F.array_sort(F.collect_set(F.when(F.col("here").isNull(), F.col("gene")))).alias("missing"))
    rows = criteria.join(per, "record_id", "left")
    status = F.when(~F.col("needs_small_variants"), "NOT_PANEL_GATED").when(F.size("genes") == 0, "NO_GENES_NAMED").when(F.size("missing") == 0, "REACHABLE").when(F.size("present") == 0, "UNREACHABLE").otherwise("PARTIAL")
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ",").alias(c)
    return rows.select("record_id", status.alias("status"), joined("present"), joined("missing"))


def single_hit(points: DataFrame, intervals: DataFrame, value: str) -> DataFrame:
    """(point_id, ``value``): the one value of the intervals that hold a point, null if they hold several or none.

    ``points(point_id, l_chrom, l_pos)``, ``intervals(r_chrom, r_start, r_end, value)``. Serves
    band names and reading-frame phases: what is not unique is not said. Points in no
    interval are listed with null.
    """
    hit = point_join(points, intervals.select("r_chrom", "r_start", "r_end", F.col(value).alias("v"))).groupBy("point_id").agg(F.collect_set("v").alias("all"))
    one = F.when(F.size("all") == 1, F.get("all", F.lit(0)))
    return points.select("point_id").distinct().join(hit, "point_id", "left").select("point_id", one.alias(value))


def phase_at(points: DataFrame, coding: DataFrame) -> DataFrame:
    """(point_id, transcript_id, phase): the phase of a transcript's coding part at a point, null unless unique."""
    spans = coding.select(F.col("chrom").alias("r_chrom"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), "transcript_id", "phase")
    spans = merged_intervals(spans, ["transcript_id", "phase"])
    hit = point_join(points, spans).groupBy("point_id", "transcript_id").agg(F.collect_set("phase").alias("all"))
    return hit.select("point_id", "transcript_id", F.when(F.size("all") == 1, F.get("all", F.lit(0))).alias("phase"))


def resolved_targets(targets: DataFrame, genes: DataFrame) -> DataFrame:
    """(target_id, gene_id, how): each target's gene, by curated id, else by label and contig.

    ``targets(target_id, curated, label, chrom)``, ``genes(gene_id, label, chrom)``. how is
    curated, label, ambiguous or unresolved; only the first two name a gene.
    """
    by_id = targets.join(genes.select(F.col("gene_id").alias("curated"), F.lit(True).alias("known")).distinct(), "curated", "left")
    named = genes.groupBy("label", "chrom").agg(F.count_distinct("gene_id").alias("n"), F.min("gene_id").alias("g"))
    rows = by_id.join(named, ["label", "chrom"], "left")
    how = F.when(F.col("known"), "curated").when(F.col("curated").isNotNull(), "unresolved").when(F.col("n") == 1, "label").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    rows = rows.withColumn("how", how)
    return rows.select("target_id", F.when(F.col("how") == "curated", F.col("curated")).when(F.col("how") == "label", F.col("g")).alias("gene_id"), "how")
