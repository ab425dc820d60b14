"""Scans: the fixtures written out as file lines and read back with reject reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from genostrata.plans.registry import query
from genostrata.sources import tables, vcf
from genostrata.sources.fixtures import fixture, sql

_K, _D = "least(support_reads, 18)", "support_reads + CASE WHEN support_reads % 9 = 0 THEN -support_reads ELSE 10 END"
_SMALL = f"""s AS (SELECT *, {_D} AS dp, {_K} + CASE WHEN support_reads % 13 = 0 THEN 1000 ELSE 0 END AS ad, support_reads % 5 = 0 AS multi, support_reads % 7 = 0 AS nodp FROM fx_calls),
r AS (SELECT event_id, CASE WHEN multi THEN 'malformed_multi_allelic' WHEN nodp THEN 'malformed_missing_depth' WHEN dp <= 0 THEN 'malformed_zero_depth' WHEN ad > dp THEN 'malformed_inconsistent_counts' END AS reason FROM s)"""


@query("scan_small_variants", f"WITH {sql('calls')}, {_SMALL} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1")
def scan_small_variants(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls")
    s = F.col("support_reads")
    depth = s + F.when(s % 9 == 0, -s).otherwise(10)
    reads = F.least(s, F.lit(18)) + F.when(s % 13 == 0, 1000).otherwise(0)
    text = lambda x: x.cast("string")
    form = F.when(s % 7 == 0, "GT:AD").otherwise("GT:DP:AD")
    sample = F.when(s % 7 == 0, F.concat(F.lit("0/1:1,"), text(reads))).otherwise(F.concat(F.lit("0/1:"), text(depth), F.lit(":1,"), text(reads)))
    line = F.concat_ws("\t", "chrom", text(F.col("start_pos")), "event_id", F.lit("A"), F.when(s % 5 == 0, "C,G").otherwise("C"), F.lit("."), "filter", F.lit("."), form, sample)
    return vcf.reasons(vcf.small_variants(c.select(line.alias("value"))))


@query("scan_structural_variants", f"""WITH {sql('calls')} SELECT coalesce(CASE WHEN filter <> 'PASS' THEN 'filter_not_pass' WHEN event_type = 'insertion' AND support_reads % 2 = 0 THEN 'unsupported_type' WHEN support_reads < 5 THEN 'low_support' WHEN end_pos - start_pos < 300 THEN 'too_short' END, 'accepted') AS reason, count(*) AS n FROM fx_calls GROUP BY 1""")
def scan_structural_variants(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls")
    s = F.col("support_reads")
    text = lambda x: x.cast("string")
    kind = F.when(F.col("event_type") == "deletion", "DEL").when(F.col("event_type") == "duplication", "DUP").when(F.col("event_type") == "inversion", "INV").when(s % 2 == 0, "CNV").otherwise("INS")
    info = F.concat(F.lit("PRECISE;SVTYPE="), kind, F.lit(";END="), text(F.col("end_pos")), F.lit(";SVLEN=-"), text(F.col("end_pos") - F.col("start_pos")), F.lit(";SUPPORT="), text(s))
    line = F.concat_ws("\t", "chrom", text(F.col("start_pos") + 1), "event_id", F.lit("N"), F.concat(F.lit("<"), kind, F.lit(">")), F.lit("60"), "filter", info, F.lit("GT:DR:DV"), F.lit("0/1:20:30"))
    return vcf.reasons(vcf.structural_variants(c.select(line.alias("value")), min_length=300))


@query("scan_target_bed", f"WITH {sql('targets')} SELECT chrom, start_pos, end_pos, CASE WHEN target_id % 3 = 0 THEN chrom || ':' || start_pos || '-' || end_pos ELSE label END AS region_id FROM fx_targets")
def scan_target_bed(spark, sf_dir):
    t = fixture(spark, sf_dir, "targets")
    text = lambda x: F.col(x).cast("string")
    line = F.concat_ws("\t", F.regexp_replace("chrom", "^chr", ""), text("start_pos"), text("end_pos"), F.when(F.col("target_id") % 3 != 0, F.regexp_replace("label", "#", "#")))
    return tables.target_bed(t.select(line.alias("value")))


@query("scan_bedmethyl", f"WITH {sql('sites')} SELECT code, count(*) AS n, CAST(sum(valid_coverage) AS BIGINT) AS valid, CAST(sum(least(modified_calls, valid_coverage)) AS BIGINT) AS modified FROM fx_sites GROUP BY 1")
def scan_bedmethyl(spark, sf_dir):
    s = fixture(spark, sf_dir, "sites")
    m = F.least("modified_calls", "valid_coverage")
    text = lambda x: x.cast("string")
    zero = [F.lit("0")] * 5
    line = F.concat_ws("\t", "chrom", text(F.col("pos")), text(F.col("pos") + 1), "code", F.lit("10"), F.lit("+"), text(F.col("pos")), text(F.col("pos") + 1), F.lit("255,0,0"), text(F.col("valid_coverage")), F.lit("0.0"), text(m), text(F.col("valid_coverage") - m), *zero)
    return tables.bedmethyl(s.select(line.alias("value"))).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("valid").alias("valid"), F.sum("n_mod").alias("modified"))


# Sites summed by position, written as combined rows: those of even positions by strand in two rows, others in one without strand.
_COMBINED = """s AS (SELECT chrom, pos, CAST(sum(valid_coverage) AS BIGINT) AS v, CAST(sum(least(modified_calls, valid_coverage)) AS BIGINT) AS m FROM fx_sites GROUP BY 1, 2)"""


@query("combined_probes", f"""WITH {sql('sites')}, {_COMBINED} SELECT 'cg' || chrom || '-' || (pos // 40000) AS probe, CAST(sum(CASE WHEN pos % 2 = 0 THEN 2 * m ELSE m END) AS BIGINT) AS modified, CAST(sum(CASE WHEN pos % 2 = 0 THEN 2 * v ELSE v END) AS BIGINT) AS valid,
  round(sum(CASE WHEN pos % 2 = 0 THEN 2 * m ELSE m END) / sum(CASE WHEN pos % 2 = 0 THEN 2 * v ELSE v END), 9) AS fraction FROM s GROUP BY 1""")
def combined_probes(spark, sf_dir):
    s = fixture(spark, sf_dir, "sites").groupBy("chrom", "pos").agg(F.sum("valid_coverage").alias("v"), F.sum(F.least("modified_calls", "valid_coverage")).alias("m"))
    strands = F.when(F.col("pos") % 2 == 0, F.array(F.lit("+"), F.lit("-"))).otherwise(F.array(F.lit(".")))
    text = lambda c: c.cast("string")
    percent = F.format_string("%.2f", 100 * F.col("m") / F.col("v"))
    zero = [F.lit("0")] * 5
    line = F.concat_ws("\t", "chrom", text(F.col("pos")), text(F.col("pos") + 1), F.lit("C"), text(F.col("v")), "strand", text(F.col("pos")), text(F.col("pos") + 1), F.lit("255,0,0"), text(F.col("v")), percent, text(F.col("m")), text(F.col("v") - F.col("m")), *zero)
    sites = tables.combined_bedmethyl(s.withColumn("strand", F.explode(strands)).select(line.alias("value")))
    probe = F.concat(F.lit("cg"), "chrom", F.lit("-"), text(F.expr("pos div 40000")))
    probes = tables.probe_positions(s.select(F.concat_ws("\t", "chrom", text(F.col("pos")), text(F.col("pos") + 1), probe).alias("value")))
    return tables.combined_probe_fractions(sites, probes).withColumn("fraction", F.round("fraction", 9))


@query("scan_structural_evidence", f"""WITH {sql('calls')}, k AS (SELECT *, start_pos % 101 AS z FROM fx_calls),
r AS (SELECT CASE WHEN event_type = 'inversion' THEN 'type_not_allowed' WHEN support_reads < 5 THEN 'low_support' WHEN z = 1 THEN 'malformed_quality' WHEN z = 2 THEN 'missing_quality' WHEN z < 10 THEN 'low_quality' WHEN z = 11 THEN 'imprecise' WHEN end_pos - start_pos < 300 THEN 'too_short'
  WHEN z = 12 THEN 'malformed_coverage' WHEN z = 13 THEN 'malformed_fraction' WHEN z = 14 THEN 'invalid_fraction' WHEN z = 15 THEN 'malformed_strands' WHEN z = 16 THEN 'malformed_mismatches' WHEN z IN (17, 18) THEN 'malformed_deviation' WHEN z = 19 THEN 'conflicting_precision' END AS reason, z, support_reads FROM k)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, CAST(sum(z) AS BIGINT) AS quality, round(sum(support_reads + 1), 6) AS coverage FROM r WHERE reason IS NULL GROUP BY 1
UNION ALL SELECT reason, count(*), NULL, NULL FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def scan_structural_evidence(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls").withColumn("z", F.col("start_pos") % 101)
    s, z, text = F.col("support_reads"), F.col("z"), lambda x: x.cast("string")
    kind = F.when(F.col("event_type") == "deletion", "DEL").when(F.col("event_type") == "duplication", "DUP").when(F.col("event_type") == "inversion", "INV").otherwise("INS")
    tags = [
        F.when(z == 11, "IMPRECISE").when(z == 19, "PRECISE;IMPRECISE").otherwise("PRECISE"), F.concat(F.lit("SVTYPE="), kind), F.concat(F.lit("END="), text(F.col("end_pos"))), F.concat(F.lit("SVLEN="), text(F.col("end_pos") - F.col("start_pos"))), F.concat(F.lit("SUPPORT="), text(s)),
        F.concat(F.lit("COVERAGE="), F.when(z == 12, "4,x,9").otherwise(F.concat(text(s), F.lit(",.,"), text(s + 2)))), F.concat(F.lit("VAF="), F.when(z == 13, "-0.5").when(z == 14, "1.5").otherwise("0.25")), F.concat(F.lit("STRAND="), F.when(z == 15, "?").otherwise("+-")),
        F.concat(F.lit("NM="), F.when(z == 16, "x").otherwise("0.01")), F.concat(F.lit("STDEV_POS="), F.when(z == 17, "-1").otherwise("0")), F.concat(F.lit("STDEV_LEN="), F.when(z == 18, "nan").otherwise("2.5")),
    ]
    quality = F.when(z == 1, "-3").when(z == 2, ".").otherwise(text(z))
    line = F.concat_ws("\t", "chrom", text(F.col("start_pos") + 1), "event_id", F.lit("N"), F.concat(F.lit("<"), kind, F.lit(">")), quality, F.lit("PASS"), F.concat_ws(";", *tags), F.lit("GT:DR:DV"), F.lit("0/1:20:30"))
    rows = vcf.structural_variants(c.select(line.alias("value")), min_length=300, allowed=("deletion", "duplication", "insertion"), min_quality=10, require_precise=True)
    fine = lambda x: F.when(F.col("reason").isNull(), x)
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(fine(F.col("quality"))).cast("long").alias("quality"), F.round(F.sum(fine(F.col("local_coverage"))), 6).alias("coverage"))
