"""Scans of caller, depth, probe and read files written out from the fixtures, labels and single-hit lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from genostrata.functions import labels
from genostrata.operators import annotate
from genostrata.plans.registry import query
from genostrata.sources import tables, vcf
from genostrata.sources.fixtures import fixture, sql


def text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("scan_depth_segments", f"""WITH {sql('calls')}, r AS (SELECT CASE WHEN filter <> 'PASS' THEN 'filter_not_pass' WHEN event_type IN ('inversion', 'insertion') THEN 'unsupported_svtype' WHEN support_reads % 11 = 0 THEN 'svtype_alt_mismatch'
  WHEN support_reads % 7 = 0 THEN 'native_length_mismatch' WHEN end_pos - start_pos < 500 THEN 'cnv_length_below_policy' WHEN support_reads % 13 = 0 THEN 'invalid_copy_number' END AS reason, end_pos - start_pos AS len FROM fx_calls)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, CAST(sum(CASE WHEN reason = 'native_length_mismatch' THEN len + 1 ELSE len END) AS BIGINT) AS bp FROM r GROUP BY 1""")
def scan_depth_segments(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls")
    s = F.col("support_reads")
    kind = F.when(F.col("event_type") == "deletion", "DEL").when(F.col("event_type") == "duplication", "DUP").otherwise("CNX")
    length = F.col("end_pos") - F.col("start_pos") + F.when(s % 7 == 0, 1).otherwise(0)
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";END="), text("end_pos"), F.lit(";SVLEN="), text(length), F.lit(";CN="), F.when(s % 13 == 0, "x").otherwise("3"))
    # A wrong length comes before its check: the line's length is what is summed.
    line = F.concat_ws("\t", "chrom", text("start_pos"), "event_id", F.lit("N"), F.when(s % 11 == 0, "<INS>").otherwise(F.concat(F.lit("<"), kind, F.lit(">"))), F.lit("9"), "filter", info, F.lit("GT"), F.lit("0/1"))
    rows = vcf.depth_segments(c.select(line.alias("value")), min_length=500)
    shown = F.when(F.col("reason") == "native_length_mismatch", F.col("length")).otherwise(F.col("end_pos") - F.col("start_pos"))
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(shown).alias("bp"))


@query("scan_paired_somatic", f"""WITH {sql('calls')}, r AS (SELECT CASE WHEN event_type = 'insertion' THEN 'unsupported_type' WHEN support_reads % 5 = 0 THEN 'class_not_accepted' WHEN support_reads < 4 THEN 'low_support' WHEN vaf < 0.02 THEN 'low_fraction' END AS reason, event_type FROM fx_calls)
SELECT coalesce(reason, 'accepted') AS reason, CASE WHEN event_type <> 'insertion' THEN event_type END AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def scan_paired_somatic(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls")
    s = F.col("support_reads")
    kind = F.when(F.col("event_type") == "deletion", "DEL").when(F.col("event_type") == "duplication", "DUP:TANDEM").when(F.col("event_type") == "inversion", "INV").otherwise("SBND")
    class_ = F.when(s % 5 == 0, ";CLASS=GERMLINE").when(s % 5 == 1, ";CLASS=SOMATIC").otherwise("")
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";END="), text("end_pos"), F.lit(";TUMOUR_READ_SUPPORT="), text(s), F.lit(";TUMOUR_AF="), text("vaf"), class_)
    line = F.concat_ws("\t", "chrom", text(F.col("start_pos") + 1), "event_id", F.lit("N"), F.lit("<SV>"), F.lit("60"), "filter", info)
    rows = vcf.structural_variants(c.select(line.alias("value")), min_support=4, min_fraction=0.02, min_length=1, pass_only=False, support_keys=("TUMOUR_READ_SUPPORT",), fraction_keys=("TUMOUR_AF",), only_class="SOMATIC")
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_UNIQUE = "u AS (SELECT DISTINCT ON (chrom, start_pos, end_pos) * FROM fx_targets ORDER BY chrom, start_pos, end_pos, target_id)"


@query("scan_target_depths", f"WITH {sql('targets')}, {_UNIQUE} SELECT chrom, count(*) AS n, round(sum(floor(mean_depth)), 3) AS depth FROM u GROUP BY 1")
def scan_target_depths(spark, sf_dir):
    t = fixture(spark, sf_dir, "targets").groupBy("chrom", "start_pos", "end_pos").agg(F.min_by("mean_depth", "target_id").alias("d"), F.min("target_id").alias("id"))
    line = F.concat_ws("\t", F.regexp_replace("chrom", "^chr", ""), text("start_pos"), text("end_pos"), F.when(F.col("id") % 2 == 0, text("id")), text(F.floor("d")))
    got = tables.target_depths(t.select(line.alias("value")), t)
    return got.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mean_depth"), 3).alias("depth"))


@query("scan_region_list", f"WITH {sql('targets')} SELECT chrom, CAST(sum(start_pos) AS BIGINT) AS starts, CAST(sum(end_pos) AS BIGINT) AS ends FROM fx_targets GROUP BY 1")
def scan_region_list(spark, sf_dir):
    line = F.concat("chrom", F.lit(":"), text(F.col("start_pos") + 1), F.lit("-"), text("end_pos"))
    return tables.region_list(fixture(spark, sf_dir, "targets").select(line.alias("value"))).groupBy("chrom").agg(F.sum("start_pos").alias("starts"), F.sum("end_pos").alias("ends"))


@query("scan_target_genes", f"WITH {sql('targets')} SELECT CASE target_id % 3 WHEN 0 THEN 'curated' WHEN 1 THEN 'label' ELSE 'unresolved' END AS resolution, count(*) AS n FROM fx_targets GROUP BY 1")
def scan_target_genes(spark, sf_dir):
    t = fixture(spark, sf_dir, "targets")
    k = F.col("target_id")
    line = F.concat_ws("\t", F.concat(F.lit("T"), text(k)), F.concat(F.lit("G"), text(k)), "chrom", F.when(k % 3 == 0, "curated").when(k % 3 == 1, "label").otherwise("unresolved"))
    head = spark.range(1).select(F.lit("target\tgene\tchrom\tresolution").alias("value"))
    return tables.target_gene_map(head.union(t.select(line))).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


@query("scan_probes", f"WITH {sql('sites')} SELECT chrom, count(*) AS n, count(*) FILTER (site_id % 4 <> 0 AND site_id % 4 <> 1) AS given FROM fx_sites GROUP BY 1")
def scan_probes(spark, sf_dir):
    k = F.col("site_id")
    line = F.concat_ws("\t", "chrom", text("pos"), text(F.col("pos") + 2), F.concat(F.lit("cg"), text(k)), F.when(k % 4 == 0, "NA").when(k % 4 != 1, "0.5"))
    return tables.probe_map(fixture(spark, sf_dir, "sites").select(line.alias("value"))).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.count("fraction").alias("given"))


_M, _H = "(user_id * 7 + event_id) % 256", "CASE WHEN (user_id * 7 + event_id) % 256 > 127 THEN (255 - (user_id * 7 + event_id) % 256) // 2 ELSE event_id % 100 END"


@query("scan_explicit_calls", f"""WITH e AS (SELECT event_id, {_M} AS m, {_H} AS h FROM events WHERE event_id % 9 <> 0)
SELECT CASE WHEN event_id % 13 = 0 THEN 'A' WHEN m / 256.0 >= 0.8 THEN 'M' WHEN greatest(0, 1 - (m + 1) / 256.0 - (h + 1) / 256.0) >= 0.8 THEN 'U' ELSE 'A' END AS state, count(*) AS n FROM e GROUP BY 1""")
def scan_explicit_calls(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    m = (F.col("user_id") * 7 + F.col("event_id")) % 256
    h = F.when(m > 127, F.floor((255 - m) / 2)).otherwise(F.col("event_id") % 100)
    one = lambda code, byte: e.select(F.concat(F.lit("r"), text("event_id")).alias("read_id"), F.lit("chr1").alias("chrom"), F.col("event_id").alias("ref_position"), F.lit("+").alias("ref_strand"), F.lit(code).alias("mod_code"), ((byte + 0.5) / 256).alias("mod_qual"), F.when(F.col("event_id") % 9 == 0, 0x100).otherwise(0).alias("flag"))
    rows = one("m", m).unionByName(one("h", h).where("ref_position % 13 <> 0"))
    return tables.explicit_calls(rows).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("scan_segments", f"WITH {sql('sites')} SELECT chrom, min(pos) FILTER (site_id % 3 = 0) AS first_used, max(pos + 1000) FILTER (site_id % 3 = 0) AS last_used, count(*) AS n, count(*) FILTER (site_id % 5 <> 0) AS with_number FROM fx_sites GROUP BY 1")
def scan_segments(spark, sf_dir):
    from genostrata.operators.metrics import assessable_extent

    k = F.col("site_id")
    line = F.concat_ws("\t", "chrom", text("pos"), text(F.col("pos") + 1000), F.when(k % 5 == 0, "NA").otherwise("2.5"), F.lit("0"), F.when(k % 3 == 0, "TRUE").otherwise("FALSE"), F.lit("zero_based_half_open"))
    head = spark.range(1).select(F.lit("chrom\tstart\tend\tcopy_number\tcall\tuse\tcoordinate_system").alias("value"))
    rows = tables.segment_table(head.union(fixture(spark, sf_dir, "sites").select(line)))
    counts = rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.count("copy_number").alias("with_number"))
    return counts.join(assessable_extent(rows), "chrom", "left")


@query("scan_knowledge", "SELECT 'r' || p_partkey AS record_id, p_brand || ',' || p_type AS genes FROM part WHERE p_size % 2 = 0")
def scan_knowledge(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    d = F.to_json(F.struct(F.concat(F.lit("r"), text("p_partkey")).alias("record_id"), F.lit("exact_pair").alias("pattern_type"), F.array("p_brand", "p_type").alias("genes"), F.when(F.col("p_size") % 2 == 0, "released").otherwise("draft").alias("status")))
    got = tables.knowledge(p.select(d.alias("value")), reportable=False).where("status = 'released'")
    return got.select("record_id", F.array_join("genes", ",").alias("genes"))


@query("event_labels", f"""WITH {sql('calls')} SELECT CASE WHEN support_reads >= 40 THEN 'REPORTABLE' ELSE 'BENCHMARK_REQUIRED' END AS release,
CASE WHEN support_reads % 4 = 0 THEN 'VALIDATED' WHEN support_reads % 4 = 1 THEN 'KNOWLEDGE_MATCH_CANDIDATE' WHEN vaf >= 0.05 THEN 'BREAKPOINT_EVIDENCE' ELSE 'NOT_APPLICABLE' END AS fusion,
CASE WHEN support_reads % 17 = 0 THEN 'HEMATOLOGY_REVIEW' WHEN vaf >= 0.05 AND filter = 'PASS' THEN 'FUSION_REVIEW' WHEN filter = 'PASS' THEN 'TECHNICAL_REVIEW' ELSE 'BACKGROUND' END AS priority,
CASE WHEN vaf < 0.02 THEN 'critical' WHEN vaf < 0.05 THEN 'review' ELSE 'unflagged' END AS tier,
CASE WHEN event_type = 'deletion' THEN 'deletion' WHEN event_type = 'duplication' THEN 'duplication' END AS kind,
coalesce(CASE WHEN support_reads % 3 = 0 THEN CAST(support_reads AS VARCHAR) END, 'n/a') AS cell, count(*) AS n FROM fx_calls GROUP BY ALL""")
def event_labels(spark, sf_dir):
    s, v = F.col("support_reads"), F.col("vaf")
    status = F.when(s % 4 == 0, "validated").when(s % 4 == 1, "candidate")
    word = F.when(F.col("event_type") == "deletion", "hetd").when(F.col("event_type") == "duplication", "AMP").otherwise("NEUT")
    c = fixture(spark, sf_dir, "calls")
    columns = {
        "release": labels.release_state(s >= 40), "fusion": labels.fusion_assessment(status, v >= 0.05),
        "priority": labels.review_priority(s % 17 == 0, v >= 0.05, F.when(F.col("filter") == "PASS", "high").otherwise("low")),
        "tier": labels.cellularity_tier(v, 0.02, 0.05), "kind": labels.call_type(word),
        "cell": labels.shown(labels.first_known(F.array(F.lit(None).cast("int"), F.when(s % 3 == 0, s)))),
    }
    return c.select(*[x.alias(k) for k, x in columns.items()]).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query("band_at_point", f"""WITH {sql('sites', 'contigs')}, b AS (SELECT chrom, i * 100000 AS s, (i + 1) * 100000 + CASE WHEN i % 4 = 0 THEN 20000 ELSE 0 END AS e, 'b' || i AS band FROM fx_contigs, range(45) r(i)),
h AS (SELECT site_id, list(DISTINCT band) FILTER (band IS NOT NULL) AS x FROM fx_sites p LEFT JOIN b ON p.chrom = b.chrom AND p.pos >= s AND p.pos < e GROUP BY 1)
SELECT site_id AS point_id, CASE WHEN len(x) = 1 THEN x[1] END AS band FROM h""")
def band_at_point(spark, sf_dir):
    i = F.col("i")
    b = fixture(spark, sf_dir, "contigs").select("chrom", F.explode(F.sequence(F.lit(0), F.lit(44))).alias("i"))
    b = b.select(F.col("chrom").alias("r_chrom"), (i.cast("long") * 100_000).alias("r_start"), ((i.cast("long") + 1) * 100_000 + F.when(i % 4 == 0, 20_000).otherwise(0)).alias("r_end"), F.concat(F.lit("b"), text(i)).alias("band"))
    points = fixture(spark, sf_dir, "sites").select(F.col("site_id").alias("point_id"), F.col("chrom").alias("l_chrom"), F.col("pos").alias("l_pos"))
    return annotate.single_hit(points, b, "band")


@query("phase_at_point", f"""WITH {sql('sites', 'targets')}, c AS (SELECT label AS transcript_id, chrom, start_pos AS s, end_pos AS e, CASE WHEN target_id % 4 < 3 THEN target_id % 4 END AS phase FROM fx_targets),
h AS (SELECT site_id, transcript_id, list(DISTINCT phase) FILTER (phase IS NOT NULL) AS x FROM fx_sites p JOIN c ON p.chrom = c.chrom AND p.pos >= s AND p.pos < e GROUP BY 1, 2)
SELECT site_id AS point_id, transcript_id, CAST(CASE WHEN len(x) = 1 THEN x[1] END AS INT) AS phase FROM h""")
def phase_at_point(spark, sf_dir):
    k = F.col("target_id")
    coding = fixture(spark, sf_dir, "targets").select(F.col("label").alias("transcript_id"), "chrom", "start_pos", "end_pos", F.when(k % 4 < 3, k % 4).cast("int").alias("phase"))
    points = fixture(spark, sf_dir, "sites").select(F.col("site_id").alias("point_id"), F.col("chrom").alias("l_chrom"), F.col("pos").alias("l_pos"))
    return annotate.phase_at(points, coding)


@query("target_resolution", f"""WITH {sql('targets')}, g AS (SELECT 'g' || target_id AS gene_id, label, chrom FROM fx_targets WHERE target_id % 3 = 0),
t AS (SELECT target_id, CASE WHEN target_id % 5 = 0 THEN 'g' || target_id END AS curated, label, chrom FROM fx_targets), n AS (SELECT label, chrom, count(*) AS n, min(gene_id) AS g FROM g GROUP BY 1, 2)
SELECT target_id, CASE WHEN curated IN (SELECT gene_id FROM g) THEN curated WHEN curated IS NULL AND n = 1 THEN g END AS gene_id,
CASE WHEN curated IN (SELECT gene_id FROM g) THEN 'curated' WHEN curated IS NOT NULL THEN 'unresolved' WHEN n = 1 THEN 'label' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how FROM t LEFT JOIN n USING (label, chrom)""")
def target_resolution(spark, sf_dir):
    t = fixture(spark, sf_dir, "targets")
    name = F.concat(F.lit("g"), text("target_id"))
    genes = t.where("target_id % 3 = 0").select(name.alias("gene_id"), "label", "chrom")
    return annotate.resolved_targets(t.select("target_id", F.when(F.col("target_id") % 5 == 0, name).alias("curated"), "label", "chrom"), genes)
