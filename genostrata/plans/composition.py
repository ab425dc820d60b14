"""Composed queries: evidence, records, resources, fusions, retention and the whole structural path."""

from __future__ import annotations

from pyspark.sql import functions as F

from genostrata.operators import benchmark, compose
from genostrata.plans.annotation import _TX, transcripts
from genostrata.plans.registry import query
from genostrata.sources.fixtures import fixture, sql
from genostrata.streaming import watch


@query("evidence_long", f"""WITH {sql('calls')}, c AS (SELECT DISTINCT ON (event_id) * FROM fx_calls ORDER BY event_id), l AS (
SELECT event_id, 'reads' AS kind, 'support_reads' AS name, CAST(support_reads AS DOUBLE) AS value FROM c UNION ALL SELECT event_id, 'reads', 'vaf', CAST(vaf AS DOUBLE) FROM c UNION ALL SELECT event_id, 'depth', 'copy_number', copy_number FROM c WHERE support_reads % 3 <> 0)
SELECT kind, name, count(*) AS n, round(sum(value), 4) AS total FROM l GROUP BY 1, 2""")
def evidence_long(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls").dropDuplicates(["event_id"])
    c = c.withColumn("copy_number", F.when(F.col("support_reads") % 3 != 0, F.col("copy_number")))
    got = compose.evidence_long(c, "event_id", {"reads": ["support_reads", "vaf"], "depth": ["copy_number"]})
    return got.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("event_records", f"""WITH {sql('calls')}, p AS (SELECT chrom || '-' || start_pos // 50000 AS event, event_id AS source FROM fx_calls)
SELECT event, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, sha256(event || '|' || string_agg(DISTINCT source, ',' ORDER BY source)) AS seal FROM p GROUP BY 1""")
def event_records(spark, sf_dir):
    event = F.concat_ws("-", "chrom", F.expr("start_pos div 50000").cast("string"))
    return compose.event_records(fixture(spark, sf_dir, "calls").select(event.alias("event"), F.col("event_id").alias("source")), "event", "source")


@query("resource_resolution", """SELECT 'p' || p_partkey % 3 AS profile, 'r' || p_partkey AS resource, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 THEN '/res/' || p_partkey END AS path,
CASE WHEN p_partkey % 7 = 0 THEN 'MISSING' WHEN p_partkey % 5 = 0 THEN 'BUILD_MISMATCH' WHEN p_partkey % 11 = 0 THEN 'CHECKSUM_MISMATCH' ELSE 'RESOLVED' END AS state FROM part""")
def resource_resolution(spark, sf_dir):
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("r"), k.cast("string")).alias("resource")
    wanted = p.select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("profile"), name, F.lit("b38").alias("build"))
    bundles = p.where(k % 7 != 0).select(name, F.when(k % 5 == 0, "b37").otherwise("b38").alias("build"), F.concat(F.lit("/res/"), k.cast("string")).alias("path"), F.lit("d").alias("expected"), F.when(k % 11 == 0, "x").otherwise("d").alias("found"))
    return compose.resolved_resources(wanted, bundles)


_SIDE = """SELECT p.event_id, arg_min(transcript_id, (tier, -cds_length, -transcript_length, transcript_id)) AS tr, CASE WHEN count(DISTINCT gene_id) = 1 THEN min(gene_id) END AS gene FROM pp p JOIN txr x ON p.{c} = x.chrom AND p.{s} >= x.start_pos AND p.{s} < x.end_pos GROUP BY 1"""


@query("fusion_sides", f"""WITH {sql('pairs', 'targets')}, {_TX}, pp AS (SELECT DISTINCT ON (event_id) * FROM fx_pairs ORDER BY event_id, start_pos),
txr AS (SELECT *, CASE WHEN mane_status = 'MANE Select' THEN 0 WHEN mane_status = 'MANE Plus Clinical' THEN 1 WHEN is_canonical OR coalesce(appris, '') LIKE 'appris_principal%' THEN 2 WHEN transcript_type = 'protein_coding' OR is_basic THEN 3 ELSE 4 END AS tier FROM tx),
a AS ({_SIDE.format(c='chrom', s='start_pos')}), b AS ({_SIDE.format(c='chrom2', s='start2')})
SELECT pp.event_id, a.tr AS left_transcript, a.gene AS left_gene, b.tr AS right_transcript, b.gene AS right_gene, 'unknown' AS frame FROM pp LEFT JOIN a USING (event_id) LEFT JOIN b ON b.event_id = pp.event_id""")
def fusion_sides(spark, sf_dir):
    return compose.fusion_sides(fixture(spark, sf_dir, "pairs").dropDuplicates(["event_id"]), transcripts(spark, sf_dir))


@query("retained_states", """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, l.n AS n_events, CASE WHEN epoch(now) - epoch(last) >= 3600 THEN 'EXPIRED' ELSE 'ACTIVE' END AS state FROM l, n""")
def retained_states(spark, sf_dir):
    return watch.retained(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", 3600)


@query("structural_path")
def structural_path(spark, sf_dir):
    calls = benchmark.one_an_id(fixture(spark, sf_dir, "calls"))
    return compose.structural_path(calls, fixture(spark, sf_dir, "targets"), min_support=5, min_depth=20.0)
