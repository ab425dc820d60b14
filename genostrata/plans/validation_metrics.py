"""Validation metrics, decisions, summaries and run states."""

from __future__ import annotations

from pyspark.sql import functions as F

from genostrata.functions import stats
from genostrata.operators import earlyexit, metrics, planning
from genostrata.plans.methylation import _MINREADS
from genostrata.plans.registry import query
from genostrata.sources.fixtures import fixture, sql


def part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


@query("lane_assignment", f"""WITH {sql('calls')}, r AS (SELECT chrom, caller, 'event' AS kind, filter = 'PASS' AS prime FROM fx_calls UNION ALL SELECT chrom, caller, 'run_summary', NULL FROM (SELECT DISTINCT chrom, caller FROM fx_calls) WHERE length(chrom) = 5 OR caller = 'caller_a')
SELECT 'lane-' || substr(sha256('"caller":["' || caller || '"],"chrom":["' || chrom || '"]'), 1, 24) AS lane, count(*) FILTER (kind = 'event') AS n_events, count(*) FILTER (kind = 'event' AND prime) AS n_primary, count(*) FILTER (kind = 'run_summary') AS run_summaries, count(*) FILTER (kind = 'run_summary') = 1 AS complete FROM r GROUP BY chrom, caller""")
def lane_assignment(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls")
    events = c.select("chrom", "caller", F.lit("event").alias("kind"), (F.col("filter") == "PASS").alias("primary"))
    runs = c.select("chrom", "caller").distinct().where("length(chrom) = 5 OR caller = 'caller_a'").select("chrom", "caller", F.lit("run_summary").alias("kind"), F.lit(None).cast("boolean").alias("primary"))
    return metrics.assigned_lanes(events.unionByName(runs), ["chrom", "caller"])


@query("metric_members", f"""WITH {sql('targets')} SELECT chrom,
coalesce(list_sort(list(DISTINCT target_id) FILTER (mean_depth >= 30 AND end_pos - start_pos >= 20000)), [])::VARCHAR AS numerator, coalesce(list_sort(list(DISTINCT target_id) FILTER (end_pos - start_pos >= 20000)), [])::VARCHAR AS denominator,
coalesce(list_sort(list(DISTINCT target_id) FILTER (end_pos - start_pos < 20000)), [])::VARCHAR AS excluded,
round(count(DISTINCT target_id) FILTER (mean_depth >= 30 AND end_pos - start_pos >= 20000) / nullif(count(DISTINCT target_id) FILTER (end_pos - start_pos >= 20000), 0), 9) AS value FROM fx_targets GROUP BY chrom""")
def metric_members(spark, sf_dir):
    rows = metrics.membership(fixture(spark, sf_dir, "targets"), "chrom", "target_id", F.col("mean_depth") >= 30, F.col("end_pos") - F.col("start_pos") >= 20_000)
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    return rows.select("chrom", *[shown(c).alias(c) for c in ("numerator", "denominator", "excluded")], "value")


@query("report_assembly", f"""WITH {sql('targets', 'calls')}, m AS (SELECT 'depth' AS family, chrom AS metric, round(avg(floor(mean_depth)), 9) AS value FROM fx_targets GROUP BY 2 UNION ALL SELECT 'calls', event_type, count(*) FROM fx_calls GROUP BY 2)
SELECT family, metric, value, row_number() OVER (ORDER BY family, metric) AS place, sha256('run|' || family || '|' || metric || '|' || format('{{:.9f}}', value)) AS seal FROM m""")
def report_assembly(spark, sf_dir):
    depth = fixture(spark, sf_dir, "targets").groupBy(F.col("chrom").alias("metric")).agg(F.avg(F.floor("mean_depth").cast("double")).alias("value"))
    calls = fixture(spark, sf_dir, "calls").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return metrics.assembled({"depth": depth, "calls": calls}, "run")


@query("validation_decisions", """SELECT p_brand AS brand, CASE WHEN bool_or(p_size = 1) OR sum(p_size // 10) = 0 THEN 'NO_CALL' WHEN bool_or(p_size % 25 = 0) THEN 'FAIL' ELSE 'PASS' END AS decision FROM part GROUP BY 1""")
def validation_decisions(spark, sf_dir):
    s = F.col("p_size")
    rows = part(spark, sf_dir).select(F.col("p_brand").alias("brand"), (s == 1).alias("ineligible"), F.floor(s / 10).alias("completed"), F.when(s % 50 == 0, None).when(s % 25 == 0, "FAIL").otherwise("PASS").alias("verdict"))
    return metrics.validation_decision(rows, "brand")


@query("recovery_verdicts", """WITH m AS (SELECT p_brand AS brand, count(*) AS completed, avg(abs(p_size - 25)) / 25 AS mae, sqrt(avg((p_size - 25) ** 2)) / 25 AS rmse, count(*) FILTER (p_size % 7 = 0) / count(*) AS no_call_rate FROM part GROUP BY 1)
SELECT brand, CASE WHEN completed < 5 THEN 'NOT_EVALUABLE' WHEN mae > 0.5 OR rmse > 0.6 OR no_call_rate > 0.15 THEN 'FAIL' ELSE 'PASS' END AS verdict,
CASE WHEN completed < 5 THEN 'too_few_levels' ELSE concat_ws(',', CASE WHEN mae > 0.5 THEN 'mae_too_high' END, CASE WHEN rmse > 0.6 THEN 'rmse_too_high' END, CASE WHEN no_call_rate > 0.15 THEN 'no_call_rate_too_high' END) END AS reasons FROM m""")
def recovery_verdicts(spark, sf_dir):
    e = F.col("p_size") - 25
    m = part(spark, sf_dir).groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("completed"), (F.avg(F.abs(e)) / 25).alias("mae"), (F.sqrt(F.avg(e * e)) / 25).alias("rmse"), (F.count_if(F.col("p_size") % 7 == 0) / F.count(F.lit(1))).alias("no_call_rate"))
    return metrics.recovery_assessment(m, max_mae=0.5, max_rmse=0.6, max_no_call=0.15, min_levels=5).select("brand", "verdict", "reasons")


@query("source_summary", f"""WITH {sql('reads')}, r AS (SELECT source, read_name, CASE WHEN marker_id % 13 = 0 THEN 'chrUn' ELSE 'chr' || (1 + marker_id % 22) END AS chrom, CASE WHEN llr >= 2.5 * num_motifs THEN 'M' WHEN llr <= -2.5 * num_motifs THEN 'U' ELSE 'A' END AS s FROM fx_reads)
SELECT source, count(*) AS rows_total, count(*) FILTER (chrom <> 'chrUn') AS rows_canonical, count(*) FILTER (chrom <> 'chrUn' AND s <> 'A') AS informative, count(*) FILTER (chrom <> 'chrUn' AND s = 'A') AS ambiguous, count(*) FILTER (chrom = 'chrUn') AS skipped, count(DISTINCT read_name) FILTER (chrom <> 'chrUn') AS read_groups FROM r GROUP BY 1""")
def source_summary(spark, sf_dir):
    from genostrata.operators.mixture import call_state

    k = F.col("marker_id")
    chrom = F.when(k % 13 == 0, "chrUn").otherwise(F.concat(F.lit("chr"), (1 + k % 22).cast("string")))
    return metrics.source_summary(fixture(spark, sf_dir, "reads").select("source", "read_name", chrom.alias("chrom"), call_state(F.col("llr"), F.col("num_motifs")).alias("state")))


@query("phase_tally", """SELECT event_id % 20 AS region, count(*) FILTER (user_id % 3 = 0) AS h1, count(*) FILTER (user_id % 3 = 1) AS h2, count(*) FILTER (user_id % 3 = 2) AS unphased, count(DISTINCT CASE WHEN user_id % 3 < 2 THEN user_id % 11 END) AS phase_sets FROM events GROUP BY 1""")
def phase_tally(spark, sf_dir):
    u = F.col("user_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return metrics.phase_tally(e.select((F.col("event_id") % 20).alias("region"), F.col("event_id").alias("read_name"), F.when(u % 3 == 0, 1).when(u % 3 == 1, 2).alias("hp"), F.when(u % 3 < 2, u % 11).alias("ps")))


@query("seeded_sample", """SELECT level, user_id FROM (SELECT 'l' || i AS level, i, user_id, row_number() OVER (PARTITION BY i ORDER BY md5('7|l' || i || '|' || user_id), user_id) AS k FROM (SELECT DISTINCT user_id FROM events), range(1, 4) r(i)) WHERE k <= 10 * i""")
def seeded_sample(spark, sf_dir):
    levels = spark.range(1, 4).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("level"), (F.col("id") * 10).alias("n"))
    return metrics.sampled(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", levels, 7)


@query("status_scan", """WITH e AS (SELECT user_id AS run, CASE WHEN event_id % 10 = 0 THEN 'lock' ELSE 'report' END AS kind, event_type AS state, event_id AS moment FROM events)
SELECT run, arg_max(state, (CASE WHEN kind = 'lock' THEN 1 ELSE 0 END) * 1000000000000 + moment) AS state FROM e GROUP BY 1""")
def status_scan(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return metrics.current_states(e.select(F.col("user_id").alias("run"), F.when(F.col("event_id") % 10 == 0, "lock").otherwise("report").alias("kind"), F.col("event_type").alias("state"), F.col("event_id").alias("at")))


@query("resume_plan", """SELECT o_orderkey AS run, 'call' AS stage, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'SKIP' ELSE 'RUN' END AS action FROM orders""")
def resume_plan(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run"), F.lit("call").alias("stage"))
    k = F.col("run")
    stages = o.withColumn("signature", F.lit("s2"))
    prior = o.select("run", "stage", F.when(k % 3 == 0, "s1").otherwise("s2").alias("signature"), F.when(k % 5 == 0, "FAILED").otherwise("COMPLETED").alias("outcome"))
    artifacts = o.select("run", "stage", F.lit("d").alias("expected"), F.when(k % 7 == 0, "x").otherwise("d").alias("found"))
    return metrics.resumable(stages, prior, artifacts)


@query("preflight_checks", """SELECT p_brand AS brand, CASE max(r) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'UNKNOWN' WHEN 1 THEN 'WARN' ELSE 'OK' END AS worst, CAST(CASE WHEN max(r) = 3 THEN 2 WHEN max(r) > 0 THEN 1 ELSE 0 END AS INT) AS exit_code
FROM (SELECT p_brand, CASE WHEN p_size = 7 THEN 3 WHEN p_size = 9 THEN 2 WHEN p_size < 4 THEN 1 ELSE 0 END AS r FROM part) GROUP BY 1""")
def preflight_checks(spark, sf_dir):
    s = F.col("p_size")
    status = F.when(s == 7, "FAIL").when(s == 9, "UNKNOWN").when(s < 4, "WARN").when(s % 2 == 0, "OK").otherwise("SKIPPED")
    return metrics.preflight(part(spark, sf_dir).select(F.col("p_brand").alias("brand"), status.alias("status")), "brand")


@query("risk_determinability", """SELECT p_brand AS brand, bool_and(p_size <> 13 AND p_size <> 17) AS determinable, coalesce(string_agg(DISTINCT 'c' || p_size, ',' ORDER BY 'c' || p_size) FILTER (p_size IN (13, 17)), '') AS blocking FROM part GROUP BY 1""")
def risk_determinability(spark, sf_dir):
    s = F.col("p_size")
    rows = part(spark, sf_dir).select(F.col("p_brand").alias("brand"), F.concat(F.lit("c"), s.cast("string")).alias("criterion"), F.when(s == 13, None).otherwise(s != 17).alias("evaluable"))
    return metrics.determinable(rows, "brand")


@query("version_pins", """SELECT 'p' || p_partkey AS component, CASE WHEN p_partkey % 7 = 0 THEN 'MISSING' WHEN p_partkey % 11 = 0 THEN 'EXTRA' WHEN p_partkey % 5 = 0 THEN 'MISMATCH' ELSE 'PINNED' END AS state FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 11 = 0)""")
def version_pins(spark, sf_dir):
    k = F.col("p_partkey")
    p = part(spark, sf_dir)
    name = F.concat(F.lit("p"), k.cast("string")).alias("component")
    return metrics.pins(p.where(k % 7 != 0).select(name, F.when(k % 5 == 0, "1.0").otherwise("1").alias("version")), p.where(k % 11 != 0).select(name, F.lit("1").alias("version")))


@query("plan_execution", """SELECT p_partkey AS lane, CASE WHEN p_partkey % 13 = 0 THEN 'UNPLANNED' WHEN p_partkey % 7 = 0 THEN 'NOT_EXECUTED' WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS state FROM part WHERE NOT (p_partkey % 13 = 0 AND p_partkey % 7 = 0)""")
def plan_execution(spark, sf_dir):
    k = F.col("lane")
    p = part(spark, sf_dir).select(F.col("p_partkey").alias("lane"))
    done = p.where(k % 7 != 0).select("lane", F.when(k % 5 == 0, "FAILED").when(k % 2 == 0, "NO_CALL").otherwise("COMPLETED").alias("outcome"), (k % 3 != 0).alias("has_evidence"))
    return metrics.plan_against_execution(p.where(k % 13 != 0), done)


@query("planning_blockers", """SELECT p_partkey AS lane, concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'no_input' END, CASE WHEN p_size > 40 THEN 'build_mismatch' END, CASE WHEN p_size % 11 = 0 THEN 'container_unpinned' END, CASE WHEN p_size < 3 THEN 'depth_unknown' END) AS blockers FROM part""")
def planning_blockers(spark, sf_dir):
    s = F.col("p_size")
    rules = [("no_input", s % 7 == 0), ("build_mismatch", s > 40), ("container_unpinned", s % 11 == 0), ("depth_unknown", F.when(s >= 3, False).otherwise(True))]
    return planning.eligibility(part(spark, sf_dir).withColumnRenamed("p_partkey", "lane"), "lane", rules).select("lane", F.col("reasons").alias("blockers"))


@query("effective_dependencies", """WITH RECURSIVE n AS (SELECT c_custkey AS node, c_custkey % 3 <> 1 AS used FROM customer), e AS (SELECT c_custkey // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey - 1, c_custkey FROM customer WHERE c_custkey > 0 AND c_nationkey % 5 = 0),
w AS (SELECT child, parent FROM e UNION SELECT w.child, e.parent FROM w JOIN n ON n.node = w.parent AND NOT n.used JOIN e ON e.child = w.parent)
SELECT w.child AS node, w.parent FROM w JOIN n a ON a.node = w.child AND a.used JOIN n b ON b.node = w.parent AND b.used""")
def effective_dependencies(spark, sf_dir):
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    nodes = c.select(k.alias("node"), (k % 3 != 1).alias("used"))
    some = c.where(k > 0)
    edges = some.select(F.expr("c_custkey div 2").alias("parent"), k.alias("child")).union(some.where("c_nationkey % 5 = 0").select(k - 1, k)).distinct()
    return planning.effective_edges(nodes, edges)


# P(X < k) of n trials at fraction p, the chance that a search by halving holds against 1 - power.
_FEWER = "list_sum(list_transform(range(0, min_reads), lambda i: exp(lgamma(depth + 1) - lgamma(i + 1) - lgamma(depth - i + 1) + i * ln(p) + (depth - i) * ln(1 - p))))"
_HALVED = f"""list_reduce([x::DOUBLE FOR x IN range(60)], lambda s, x: list_transform([s.low + s.high], lambda q: list_transform([q / 2], lambda p: CASE WHEN {_FEWER} <= 1 - 0.95 THEN {{'low': s.low, 'high': p}} ELSE {{'low': p, 'high': s.high}} END)[1])[1], {{'low': 0.0::DOUBLE, 'high': 1.0::DOUBLE}}).high"""
_HALVED = _HALVED.replace("[x::DOUBLE FOR x IN range(60)]", "[{'low': x::DOUBLE, 'high': 0.0::DOUBLE} FOR x IN range(60)]")


@query("detectable_fractions", f"""WITH {sql('calls')}, rows AS (SELECT DISTINCT support_reads * 3 + 7 AS depth, vaf * 10 AS fraction FROM fx_calls), depths AS (SELECT DISTINCT depth FROM rows), {_MINREADS},
v AS (SELECT depth, min_reads, CASE WHEN min_reads <= depth THEN {_HALVED} END AS v FROM mr)
SELECT depth, round(fraction, 6) AS fraction, CAST(min_reads AS INT) AS min_reads, round(v, 9) AS min_vaf, round(CASE WHEN fraction > 0 AND fraction <= 1 AND 2 * v / fraction <= 1 THEN 2 * v / fraction END, 9) AS min_ccf FROM rows JOIN v USING (depth)""")
def detectable_fractions(spark, sf_dir):
    rows = fixture(spark, sf_dir, "calls").select((F.col("support_reads") * 3 + 7).alias("depth"), (F.col("vaf") * 10).alias("fraction")).distinct()
    got = rows.join(stats.min_detectable(stats.min_variant_reads(rows, 0.01, 0.01)), "depth")
    clone = stats.detectable_clone(F.col("min_vaf"), F.col("fraction"))
    return got.select("depth", F.round("fraction", 6).alias("fraction"), "min_reads", F.round("min_vaf", 9).alias("min_vaf"), F.round(clone, 9).alias("min_ccf"))


# What a row shows: a hit at every 997th of one kind, a few that are broken, some that are odd.
_SHOWN = "CASE WHEN event_id % 997 = 613 AND value >= {cut} THEN 'detected' WHEN event_id % 401 = 17 THEN 'invalid' WHEN event_id % 50 = 3 THEN 'unsupported' ELSE 'nothing' END"
_SCANS = {"early": (0, None), "budget": (0, 300), "late": (95, None), "none": (1000, None), "small": (1000, 40)}


def _scan_sql(name: str, cut: int, most: int | None) -> str:
    limit = "" if most is None else f" LIMIT {most}"
    return f"""SELECT '{name}' AS scan, coalesce(hit.s, CASE WHEN bool_or(r.s = 'invalid') THEN 'invalid' ELSE coalesce(min_by(r.s, r.event_id) FILTER (r.s <> 'nothing'), CASE WHEN n.n < {most or 10**18} THEN 'nothing' ELSE 'sample_incomplete' END) END) AS reason,
  count(*) AS checked, hit.event_id IS NULL AND any_value(n.n) < {most or 10**18} AS complete, hit.event_id AS confirmed
FROM (SELECT event_id, {_SHOWN.format(cut=cut)} AS s FROM events ORDER BY event_id{limit}) r, (SELECT count(*) AS n FROM events) n,
  (SELECT min(event_id) AS event_id, CASE WHEN count(*) > 0 THEN 'detected' END AS s FROM (SELECT event_id, {_SHOWN.format(cut=cut)} AS s FROM events ORDER BY event_id{limit}) WHERE s = 'detected') hit
WHERE hit.event_id IS NULL OR r.event_id <= hit.event_id GROUP BY hit.s, hit.event_id, n.n"""


@query("early_exit_scans", "\nUNION ALL ".join(_scan_sql(k, *v) for k, v in _SCANS.items()))
def early_exit_scans(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = None
    for name, (cut, most) in _SCANS.items():
        got = earlyexit.bounded_scan(events, "event_id", F.expr(_SHOWN.format(cut=cut)), most=most, first=256).withColumn("scan", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out
