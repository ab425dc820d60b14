"""Event classification, scoring and review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genostrata.functions import evidence as ev
from genostrata.functions import labels
from genostrata.functions.coords import contig_rank
from genostrata.plans.registry import query
from genostrata.sources.fixtures import fixture, sql

_REASON = """CASE WHEN filter <> 'PASS' THEN 'filter_not_pass' WHEN event_type NOT IN ('deletion', 'duplication', 'inversion') THEN 'unsupported_type'
  WHEN support_reads < 5 THEN 'low_support' WHEN end_pos - start_pos < 250 THEN 'too_short' WHEN vaf < 0.02 THEN 'low_vaf' END"""


def policy_reason(calls: DataFrame):
    """The first rule a call breaks, in the order filter, type, support, length, allele fraction."""
    return ev.first_reason([
        ("filter_not_pass", F.col("filter") != "PASS"),
        ("unsupported_type", ~F.col("event_type").isin("deletion", "duplication", "inversion")),
        ("low_support", F.col("support_reads") < 5),
        ("too_short", F.col("end_pos") - F.col("start_pos") < 250),
        ("low_vaf", F.col("vaf") < 0.02),
    ])


@query("sv_policy_filter", f"WITH {sql('calls')} SELECT event_id, {_REASON} AS reason FROM fx_calls")
def sv_policy_filter(spark, sf_dir):
    calls = fixture(spark, sf_dir, "calls")
    return calls.select("event_id", policy_reason(calls).alias("reason"))


@query("reject_reason_histogram", f"WITH {sql('calls')}, r AS (SELECT caller, coalesce({_REASON}, 'accepted') AS reason FROM fx_calls) SELECT caller, reason, count(*) AS n FROM r GROUP BY ALL")
def reject_reason_histogram(spark, sf_dir):
    calls = fixture(spark, sf_dir, "calls")
    return calls.groupBy("caller", F.coalesce(policy_reason(calls), F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def clusters(spark, sf_dir) -> DataFrame:
    """Calls gathered by contig, type and 20 kb piece: events with an evidence array."""
    calls = fixture(spark, sf_dir, "calls").withColumn("piece", F.expr("start_pos div 20000"))
    packed = F.collect_list(F.struct("event_id", "caller", "support_reads", "vaf", "filter"))
    return calls.groupBy("chrom", "event_type", "piece").agg(F.array_sort(packed).alias("evidence"), F.min("start_pos").alias("start_pos")).withColumn("event_id", F.concat_ws("-", "chrom", "event_type", F.col("piece").cast("string")))


_GROUPED = f"""{sql('calls')}, g AS (
  SELECT chrom || '-' || event_type || '-' || (start_pos // 20000) AS event_id, chrom, event_type, start_pos // 20000 AS piece, min(start_pos) AS start_pos,
         max(support_reads) AS support, max(vaf) AS vaf, count(DISTINCT caller) AS n_callers, array_to_string(list_sort(list(DISTINCT caller)), ',') AS callers,
         bool_and(filter = 'PASS') AS clean, count(*) AS n FROM fx_calls GROUP BY ALL)"""


@query("event_evidence_arrays", f"WITH {_GROUPED} SELECT event_id, support, round(vaf, 6) AS vaf, callers, clean, n FROM g")
def event_evidence_arrays(spark, sf_dir):
    e = clusters(spark, sf_dir)
    return e.select("event_id", ev.max_support(F.col("evidence")).alias("support"), F.round(ev.best_vaf(F.col("evidence")), 6).alias("vaf"), F.array_join(ev.callers(F.col("evidence")), ",").alias("callers"), ev.clean(F.col("evidence")).alias("clean"), F.size("evidence").cast("long").alias("n"))


_SCORED = f"""{_GROUPED}, s AS (SELECT *,
  CASE WHEN n_callers >= 2 THEN 4 WHEN n_callers = 1 THEN 1 ELSE 0 END
  + CASE WHEN support >= 20 THEN 4 WHEN support >= 10 THEN 2 WHEN support >= 5 THEN 1 ELSE 0 END
  + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END
  + CASE WHEN vaf >= 0.10 THEN 2 WHEN vaf >= 0.05 THEN 1 ELSE 0 END
  + CASE WHEN clean THEN 0 ELSE -3 END
  + CASE piece % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END
  - least(3, piece % 5 - CASE WHEN piece % 5 > 0 THEN 1 ELSE 0 END)
  + CASE WHEN piece % 11 = 0 THEN 2 ELSE 0 END
  + CASE WHEN event_type = 'inversion' AND support >= 10 THEN 1 ELSE 0 END AS score FROM g),
c AS (SELECT *, CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'moderate' ELSE 'low' END AS confidence FROM s)"""


def scored(spark, sf_dir) -> DataFrame:
    """Clusters with score and confidence; flags and observability follow from the piece."""
    e = clusters(spark, sf_dir)
    names = [F.lit("umap:mappability"), *(F.lit(f"blacklist:{i}") for i in range(4))]
    flags = F.slice(F.array(*names), F.lit(1), (F.col("piece") % 5).cast("int"))
    observed = F.when(F.col("piece") % 3 == 0, "observed_adequately").when(F.col("piece") % 3 == 1, "outside_target").otherwise("not_assessed")
    x = F.col("evidence")
    value = ev.score(support=ev.max_support(x), n_callers=F.size(ev.callers(x)), vaf=ev.best_vaf(x), is_precise=F.size(x) % 2 == 0, is_clean=ev.clean(x), observability=observed, flags=flags, known=F.col("piece") % 11 == 0, event_type=F.col("event_type"))
    e = e.withColumn("score", value).withColumn("confidence", ev.tier(F.col("score")))
    return e.withColumn("support", ev.max_support(x)).withColumn("n_callers", F.size(ev.callers(x)))


@query("evidence_score", f"WITH {_SCORED} SELECT event_id, CAST(score AS INT) AS score, confidence FROM c")
def evidence_score(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "score", "confidence")


@query("review_queue", f"""WITH {_SCORED}
SELECT event_id, confidence, support, start_pos FROM c WHERE confidence <> 'low'
ORDER BY CASE confidence WHEN 'high' THEN 0 ELSE 1 END, CASE WHEN event_type = 'translocation' THEN 0 ELSE 1 END, support DESC, chrom, start_pos, event_id LIMIT 50""")
def review_queue(spark, sf_dir):
    rows = scored(spark, sf_dir).where("confidence <> 'low'")
    order = [ev.tier_order(F.col("confidence")), F.when(F.col("event_type") == "translocation", 0).otherwise(1), F.desc("support"), "chrom", "start_pos", "event_id"]
    return rows.orderBy(*order).limit(50).select("event_id", "confidence", "support", "start_pos")


@query("key_findings", f"""WITH {_SCORED}
SELECT event_id, piece % 11 = 0 AS known, confidence, n_callers, support FROM c
ORDER BY CASE WHEN piece % 11 = 0 THEN 0 ELSE 1 END, CASE confidence WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, n_callers DESC, support DESC, event_id LIMIT 25""")
def key_findings(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("known", F.col("piece") % 11 == 0)
    order = [F.desc("known"), ev.tier_order(F.col("confidence")), F.desc("n_callers"), F.desc("support"), "event_id"]
    return rows.orderBy(*order).limit(25).select("event_id", "known", "confidence", F.col("n_callers").cast("long").alias("n_callers"), "support")


@query("numeric_bands", f"""WITH {sql('calls')}
SELECT CASE WHEN end_pos - start_pos < 500 THEN '<500' WHEN end_pos - start_pos < 1000 THEN '[500,1000)' WHEN end_pos - start_pos < 2000 THEN '[1000,2000)' ELSE '>=2000' END AS band,
       CASE WHEN event_type IN ('deletion', 'duplication') AND copy_number IS NOT NULL THEN 'cnv' ELSE 'sv' END AS class, count(*) AS n FROM fx_calls GROUP BY ALL""")
def numeric_bands(spark, sf_dir):
    size = labels.band(F.col("end_pos") - F.col("start_pos"), (500, 1000, 2000))
    kind = labels.event_class(F.col("event_type"), F.col("copy_number"))
    return fixture(spark, sf_dir, "calls").groupBy(size.alias("band"), kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("qc_gates", f"""WITH {sql('targets')}, m AS (SELECT chrom, avg(mean_depth) AS mean_depth, CAST(count(*) AS DOUBLE) AS targets, min(mean_depth) AS min_depth FROM fx_targets GROUP BY chrom),
l AS (SELECT chrom, 'mean_depth' AS metric, mean_depth AS value FROM m UNION ALL SELECT chrom, 'targets', targets FROM m UNION ALL SELECT chrom, 'min_depth', min_depth FROM m),
g AS (SELECT * FROM (VALUES ('mean_depth', 27.0), ('targets', 80.0), ('n50', 1000.0)) v(metric, floor_)),
j AS (SELECT c.chrom, g.metric, l.value IS NULL OR l.value < g.floor_ AS failed FROM (SELECT DISTINCT chrom FROM m) c CROSS JOIN g LEFT JOIN l ON l.chrom = c.chrom AND l.metric = g.metric)
SELECT chrom, array_to_string(list_sort(list(metric) FILTER (failed)), ',') AS failed_gates, CASE WHEN bool_or(failed) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM j GROUP BY chrom""")
def qc_gates(spark, sf_dir):
    m = fixture(spark, sf_dir, "targets").groupBy("chrom").agg(F.avg("mean_depth").alias("mean_depth"), F.count(F.lit(1)).cast("double").alias("targets"), F.min("mean_depth").alias("min_depth"))
    floors = {"mean_depth": 27.0, "targets": 80.0, "n50": 1000.0}
    failed, verdict = labels.gates({c: F.col(c) for c in ("mean_depth", "targets", "min_depth")}, floors)
    return m.select("chrom", failed.alias("failed_gates"), verdict.alias("verdict"))


@query("gene_pair_labels", f"""WITH {sql('calls', 'targets')}, h AS (
  SELECT c.event_id, coalesce(list_sort(list(DISTINCT t.label) FILTER (t.label IS NOT NULL)), []) AS genes FROM fx_calls c LEFT JOIN fx_targets t ON c.chrom = t.chrom AND c.start_pos < t.end_pos AND t.start_pos < c.end_pos GROUP BY 1)
SELECT event_id, CASE WHEN len(genes) >= 2 THEN genes[1] || '::' || genes[2] ELSE coalesce(genes[1], 'unannotated') END AS label FROM h""")
def gene_pair_labels(spark, sf_dir):
    from genostrata.operators.rangejoin import merged_intervals, overlap_join
    from genostrata.plans.intervals import left, right

    calls = fixture(spark, sf_dir, "calls")
    hit = overlap_join(left(calls, "event_id"), merged_intervals(right(fixture(spark, sf_dir, "targets"), "label"), ["label"])).groupBy("event_id").agg(F.array_sort(F.collect_set("label")).alias("genes"))
    rows = calls.select("event_id").distinct().join(hit, "event_id", "left").withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))
    return rows.select("event_id", ev.gene_pair_label(F.lit(None).cast("string"), F.col("genes")).alias("label"))


@query("natural_order_rank", f"""WITH {sql('targets')}
SELECT target_id, row_number() OVER (PARTITION BY chrom ORDER BY mean_depth, start_pos, target_id) AS rank_in_chrom, CAST(replace(chrom, 'chr', '') AS INT) AS chrom_rank FROM fx_targets""")
def natural_order_rank(spark, sf_dir):
    order = Window.partitionBy("chrom").orderBy("mean_depth", "start_pos", "target_id")
    return fixture(spark, sf_dir, "targets").select("target_id", F.row_number().over(order).cast("long").alias("rank_in_chrom"), contig_rank(F.col("chrom")).alias("chrom_rank"))


@query("redact_and_escape", """SELECT event_id, regexp_replace(props, '/[A-Za-z0-9_./-]+', '<path>', 'g') AS redacted,
  CASE WHEN regexp_matches(event_type, '^[=+@-]') THEN '''' || event_type ELSE event_type END AS cell,
  'tf' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '_r' || (event_id % 3) AS level_id FROM events""")
def redact_and_escape(spark, sf_dir):
    from genostrata.functions import text
    from genostrata.sources.fixtures import table

    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.redact_paths(F.col("props")).alias("redacted"), text.safe_cell(F.col("event_type")).alias("cell"), F.format_string("tf%04d_r%d", F.col("event_id") % 10000, F.col("event_id") % 3).alias("level_id"))
