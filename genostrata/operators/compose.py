"""Composition: evidence in long form, event records, projections of fusions, and the whole path of a call set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genostrata.functions import evidence as ev
from genostrata.operators import consensus, coverage
from genostrata.operators.annotate import ranked_transcripts
from genostrata.operators.rangejoin import merged_intervals, overlap_join, point_join


def evidence_long(rows: DataFrame, key: str, kinds: dict[str, list[str]]) -> DataFrame:
    """(key, kind, name, value): the measurements of every kind (kind to columns), nulls left out."""
    out = None
    for kind, columns in kinds.items():
        long = rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "name", "value").where("value IS NOT NULL")
        long = long.select(key, F.lit(kind).alias("kind"), "name", "value")
        out = long if out is None else out.unionByName(long)
    return out


def event_records(members: DataFrame, event: str, source: str) -> DataFrame:
    """(event, n_sources, sources, seal): sorted distinct source ids of each event and the SHA-256 of event and sources."""
    per = members.where(F.col(source).isNotNull()).groupBy(event).agg(F.array_sort(F.collect_set(source)).alias("s"))
    text = F.array_join("s", ",")
    return per.select(event, F.size("s").cast("long").alias("n_sources"), text.alias("sources"), F.sha2(F.concat_ws("|", F.col(event).cast("string"), text), 256).alias("seal"))


def resolved_resources(wanted: DataFrame, bundles: DataFrame) -> DataFrame:
    """(profile, resource, path, state) of ``wanted(profile, resource, build)`` in ``bundles(resource, build, path, expected, found)``.

    RESOLVED, MISSING (no bundle), BUILD_MISMATCH (only of other builds) or CHECKSUM_MISMATCH; a path only if resolved.
    """
    any_build = bundles.select("resource", F.lit(True).alias("some")).distinct()
    rows = wanted.join(bundles, ["resource", "build"], "left").join(any_build, "resource", "left")
    state = F.when(F.col("some").isNull(), "MISSING").when(F.col("path").isNull(), "BUILD_MISMATCH").when(~F.coalesce(F.col("expected") == F.col("found"), F.lit(False)), "CHECKSUM_MISMATCH").otherwise("RESOLVED")
    return rows.select("profile", "resource", F.when(state == "RESOLVED", F.col("path")).alias("path"), state.alias("state"))


def fusion_sides(pairs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(event_id, left_transcript, left_gene, right_transcript, right_gene, frame) of paired events.

    Each side takes the preferred of the transcripts that hold its breakpoint; a side with
    several genes names none. The reading frame is never claimed: ``unknown``.
    """
    ranked = ranked_transcripts(transcripts).select("transcript_id", "rank", "tier")
    spans = transcripts.join(ranked, "transcript_id").select(F.col("chrom").alias("r_chrom"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), "transcript_id", "gene_id", "tier", "cds_length", "transcript_length")
    sides = {"left": ("chrom", "start_pos"), "right": ("chrom2", "start2")}
    out = pairs.select("event_id").distinct()
    for side, (chrom, pos) in sides.items():
        # Each breakpoint is looked up once, however many events share it.
        ends = pairs.select("event_id", F.col(chrom).alias("l_chrom"), F.col(pos).alias("l_pos"))
        hit = point_join(ends.select("l_chrom", "l_pos").distinct(), spans)
        order = F.struct("tier", -F.col("cds_length"), -F.col("transcript_length"), "transcript_id")
        best = hit.groupBy("l_chrom", "l_pos").agg(F.min_by("transcript_id", order).alias(f"{side}_transcript"), F.when(F.count_distinct("gene_id") == 1, F.min("gene_id")).alias(f"{side}_gene"))
        out = out.join(ends.join(best, ["l_chrom", "l_pos"]).drop("l_chrom", "l_pos"), "event_id", "left")
    return out.withColumn("frame", F.lit("unknown"))


def structural_path(calls: DataFrame, targets: DataFrame, *, min_support: int, min_depth: float, policy: consensus.Policy = consensus.Policy()) -> DataFrame:
    """Calls to scored candidates: filter, clusters of callers, genes, observability, score and tier.

    ``calls`` as ``consensus.cluster_calls`` and ``merged`` read them, with filter and vaf; ``targets(chrom,
    start_pos, end_pos, label, mean_depth)``. One row a cluster.
    """
    usable = calls.where((F.col("filter") == "PASS") & (F.col("support_reads") >= min_support))
    clusters = consensus.cluster_calls(usable, policy)
    members = usable.join(clusters, "event_id").groupBy("head").agg(F.max("support_reads").alias("support"), F.max("vaf").alias("vaf"))
    events = consensus.merged(usable, clusters).join(members, "head").withColumn("event_id", F.col("representative"))
    spans = targets.select(F.col("chrom").alias("r_chrom"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), "label")
    loci = events.select("event_id", F.col("chrom").alias("l_chrom"), F.col("start_pos").alias("l_start"), F.col("end_pos").alias("l_end"))
    genes = overlap_join(loci, merged_intervals(spans, ["label"])).groupBy("event_id").agg(F.array_sort(F.collect_set("label")).alias("genes"))
    seen = coverage.observability(events, targets, min_depth)
    rows = events.join(genes, "event_id", "left").join(seen, "event_id", "left").withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))
    n = F.size(F.split("callers", ","))
    value = ev.score(support=F.col("support"), n_callers=n, vaf=F.col("vaf"), is_precise=F.lit(False), is_clean=F.lit(True), observability=F.col("observability"), flags=F.array().cast("array<string>"), known=F.lit(False), event_type=F.col("event_type"))
    rows = rows.withColumn("score", value)
    return rows.select("event_id", "event_type", "chrom", "start_pos", "end_pos", "callers", "n_members", F.array_join("genes", ",").alias("genes"), "observability", "score", ev.tier(F.col("score")).alias("confidence"))
