"""Report contracts over tables with planted faults: what is planted is what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from genostrata.operators import coverage, validators
from genostrata.plans.registry import query
from genostrata.sources.fixtures import fixture, sql, table

_TARGETS = f"WITH {sql('targets')}, t AS (SELECT *, end_pos - start_pos AS len FROM fx_targets)"


@query("check_thresholds", f"""{_TARGETS}, w AS (SELECT target_id, len, CASE WHEN target_id % 41 = 0 THEN len + 1 ELSE len END AS a, CASE WHEN mean_depth >= 20 THEN len ELSE 0 END AS b, CASE WHEN target_id % 37 = 0 THEN 7 ELSE 0 END AS c FROM t)
SELECT CAST(target_id AS VARCHAR) AS key, 'bases_rise_with_depth' AS rule FROM w WHERE NOT (a <= len AND b <= a AND c <= b)
UNION ALL SELECT CAST(target_id AS VARCHAR), 'fraction_is_not_bases_by_length' FROM w WHERE target_id % 43 = 0""")
def check_thresholds(spark, sf_dir):
    k = F.col("target_id")
    t = fixture(spark, sf_dir, "targets").withColumn("length", F.col("end_pos") - F.col("start_pos"))
    bases = {10: F.when(k % 41 == 0, F.col("length") + 1).otherwise(F.col("length")), 20: F.when(F.col("mean_depth") >= 20, F.col("length")).otherwise(0), 30: F.when(k % 37 == 0, 7).otherwise(0)}
    wide = t.select("target_id", "length", *[c.cast("long").alias(f"{d}X") for d, c in bases.items()])
    for d in bases:
        wide = wide.withColumn(f"{d}X_fraction", F.col(f"{d}X") / F.col("length") + (F.when(k % 43 == 0, 0.01).otherwise(0.0) if d == 20 else 0))
    return validators.thresholds(wide, "target_id", list(bases))


@query("check_coverage_summary", f"""{_TARGETS} SELECT chrom AS key, 'weighted_mean_differs' AS rule FROM (SELECT DISTINCT chrom FROM t) WHERE length(chrom) = 4
UNION ALL SELECT 'chr0', 'row_without_like'""")
def check_coverage_summary(spark, sf_dir):
    again = coverage.summary(fixture(spark, sf_dir, "targets"), thresholds=(20, 30))
    # The report at hand has a wrong mean for contigs of one digit, and a contig too many.
    report = again.withColumn("weighted_mean", F.col("weighted_mean") + F.when(F.length("chrom") == 4, 0.001).otherwise(0.0))
    extra = report.limit(1).withColumn("chrom", F.lit("chr0"))
    return validators.summary_differs(report.unionByName(extra), again, "chrom")


@query("check_sidecars", """WITH s AS (SELECT p_partkey AS artifact, 's' || p_size % 7 AS sample, CASE WHEN p_partkey % 11 = 0 THEN 'b37' ELSE 'b38' END AS build FROM part),
e AS (SELECT 's' || i AS sample FROM range(6) r(i))
SELECT CAST(artifact AS VARCHAR) AS key, 'foreign_sample' AS rule FROM s WHERE sample NOT IN (SELECT sample FROM e)
UNION ALL SELECT CAST(artifact AS VARCHAR), 'foreign_build' FROM s WHERE sample IN (SELECT sample FROM e) AND build = 'b37'
UNION ALL SELECT CAST(artifact AS VARCHAR), 'conflicting_repeats' FROM s WHERE artifact % 13 = 0
UNION ALL SELECT CAST(artifact AS VARCHAR), 'foreign_sample' FROM s WHERE artifact % 13 = 0 AND sample NOT IN (SELECT sample FROM e)
UNION ALL SELECT CAST(artifact AS VARCHAR), 'foreign_build' FROM s WHERE artifact % 13 = 0 AND sample IN (SELECT sample FROM e) AND build = 'b37'""")
def check_sidecars(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one = p.select(F.col("p_partkey").alias("artifact"), F.concat(F.lit("s"), (F.col("p_size") % 7).cast("string")).alias("sample"), F.when(F.col("p_partkey") % 11 == 0, "b37").otherwise("b38").alias("build"), F.lit("d1").alias("digest"))
    again = one.where("artifact % 13 = 0").withColumn("digest", F.lit("d2"))
    expected = spark.range(6).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample"), F.lit("b38").alias("build"))
    return validators.foreign_sidecars(one.unionByName(again), expected)


# The lock of the panel as it is, of one with a target more, and of one whose targets lie elsewhere: the first one holds.
_HEAD = "CAST(('0x' || substr(sha256(chrom || chr(9) || start_pos || chr(9) || {end} || chr(9) || label), 1, 12)) AS BIGINT)"


@query("check_panel_lock", f"""WITH {sql('targets')}, t AS (SELECT * FROM fx_targets), own AS (SELECT count(*) AS n, sum({_HEAD.format(end='end_pos')}) AS d FROM t),
moved AS (SELECT sum({_HEAD.format(end="(end_pos + CASE WHEN target_id % 50 = 7 THEN 1 ELSE 0 END)")}) AS d FROM t)
SELECT 'exact' AS key, 'never' AS rule FROM own WHERE n < 0
UNION ALL SELECT 'longer', 'row_count' FROM own WHERE n > 0 UNION ALL SELECT 'longer', 'role'
UNION ALL SELECT 'moved', 'content' FROM own, moved WHERE own.d <> moved.d""")
def check_panel_lock(spark, sf_dir):
    t = fixture(spark, sf_dir, "targets")
    lock = validators.panel_facts(t).first().asDict()
    moved = t.withColumn("end_pos", F.col("end_pos") + F.when(F.col("target_id") % 50 == 7, 1).otherwise(0))
    cases = {"exact": (t, lock, "selection"), "longer": (t, lock | {"n": lock["n"] + 1}, "buffered"), "moved": (moved, lock, "selection")}
    out = None
    for name, (panel, facts, role) in cases.items():
        got = validators.panel_lock(panel, **facts, role=role, declared="selection", name=name)
        out = got if out is None else out.unionByName(got)
    return out


@query("check_regions", f"""WITH {sql('sites')}, s AS (SELECT site_id, valid_coverage AS valid, least(modified_calls, valid_coverage) AS m, site_id % 53 = 0 AS p, site_id % 59 = 0 AS q, site_id % 61 = 0 AS r FROM fx_sites)
SELECT CAST(site_id AS VARCHAR) AS key, 'counts_do_not_add_up' AS rule FROM s WHERE p
UNION ALL SELECT CAST(site_id AS VARCHAR), 'fraction_without_site' FROM s WHERE q
UNION ALL SELECT CAST(site_id AS VARCHAR), 'fraction_differs' FROM s WHERE r AND NOT q""")
def check_regions(spark, sf_dir):
    k = F.col("site_id")
    s = fixture(spark, sf_dir, "sites").withColumn("modified", F.least("modified_calls", "valid_coverage"))
    rows = s.select("site_id", "modified", (F.col("valid_coverage") - F.col("modified") + F.when(k % 53 == 0, 1).otherwise(0)).alias("canonical"), F.lit(0).alias("other"), F.col("valid_coverage").alias("valid"), F.when(k % 59 == 0, 0).otherwise(1).alias("n_sites"), (F.col("modified") / F.col("valid_coverage") + F.when(k % 61 == 0, 0.5).otherwise(0.0)).alias("fraction"))
    return validators.region_counts(rows, "site_id")


@query("check_haplotypes", f"""WITH {sql('sites')}, s AS (SELECT site_id, site_id % 3 <> 0 AS has1, site_id % 5 <> 0 AS has2, site_id % 67 = 0 AS p, site_id % 71 = 0 AS q FROM fx_sites)
SELECT CAST(site_id AS VARCHAR) AS key, 'difference_without_both' AS rule FROM s WHERE p AND NOT (has1 AND has2)
UNION ALL SELECT CAST(site_id AS VARCHAR), 'difference_missing' FROM s WHERE q AND NOT p AND has1 AND has2
UNION ALL SELECT CAST(site_id AS VARCHAR), 'difference_differs' FROM s WHERE p""")
def check_haplotypes(spark, sf_dir):
    k = F.col("site_id")
    h1, h2 = F.when(k % 3 != 0, 0.75), F.when(k % 5 != 0, 0.25)
    difference = F.when(k % 67 == 0, 0.9).when(k % 71 == 0, None).otherwise(h1 - h2)
    return validators.haplotype_difference(fixture(spark, sf_dir, "sites").select("site_id", h1.alias("h1"), h2.alias("h2"), difference.alias("difference")), "site_id")


@query("check_levels", """SELECT 'c' || c_custkey AS key, 'level_missing' AS rule FROM customer WHERE c_custkey % 17 = 0
UNION ALL SELECT 'c' || c_custkey || 'x', 'level_not_registered' FROM customer WHERE c_custkey % 19 = 0 AND c_custkey % 17 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'seed_used_twice' FROM customer WHERE c_custkey % 23 = 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND (c_custkey - 1) % 17 <> 0 AND (c_custkey - 1) % 19 <> 0 AND c_custkey > 1
UNION ALL SELECT 'c' || (c_custkey - 1), 'seed_differs' FROM customer WHERE c_custkey % 23 = 0 AND (c_custkey - 1) % 17 <> 0 AND (c_custkey - 1) % 19 <> 0 AND c_custkey > 1
UNION ALL SELECT 'c' || c_custkey, 'level_missing' FROM customer WHERE c_custkey % 19 = 0 AND c_custkey % 17 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'seed_used_twice' FROM customer WHERE c_custkey % 23 = 0 AND c_custkey % 19 = 0 AND c_custkey % 17 <> 0 AND (c_custkey - 1) % 17 <> 0""")
def check_levels(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    k = F.col("c_custkey")
    name = F.concat(F.lit("c"), k.cast("string"))
    grid = c.select(name.alias("level"), k.alias("seed"))
    # Missing at 17, renamed at 19, and the level before each 23rd uses the seed after it.
    levels = c.where(k % 17 != 0).select(F.when(k % 19 == 0, F.concat(name, F.lit("x"))).otherwise(name).alias("level"), F.when(((k + 1) % 23 == 0) & (k % 19 != 0), k + 1).otherwise(k).alias("seed"))
    top = c.agg(F.max("c_custkey")).first()[0]
    return validators.registered_levels(levels.where(F.col("seed") <= top), grid, "level")


@query("check_grid", """WITH g AS (SELECT 'L' || p_partkey AS level, (p_size - 3) / 46.0::DOUBLE AS fraction, CASE WHEN p_partkey % 3 = 0 THEN 46 * p_partkey ELSE 46 * p_partkey + 1 END AS total FROM part)
SELECT level AS key, 'fraction_out_of_range' AS rule FROM g WHERE fraction < 0 OR fraction > 1
UNION ALL SELECT level, 'budget_cannot_show_fraction' FROM g WHERE abs(total * fraction - round(total * fraction)) >= 1e-6
UNION ALL SELECT CAST(fraction AS VARCHAR), 'fraction_repeated' FROM g GROUP BY fraction HAVING count(*) > 1
UNION ALL SELECT 'grid', 'no_zero' FROM g HAVING min(fraction) <> 0 UNION ALL SELECT 'grid', 'no_one' FROM g HAVING max(fraction) <> 1""")
def check_grid(spark, sf_dir):
    k = F.col("p_partkey")
    total = k * 46 + F.when(k % 3 == 0, 0).otherwise(1)
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("L"), k.cast("string")).alias("level"), ((F.col("p_size") - 3) / 46.0).alias("fraction"), total.alias("total"))
    return validators.grid_coherence(rows)


_EVIDENCE = f"""WITH {sql('calls')}, c AS (SELECT DISTINCT ON (event_id) event_id, chrom, event_type, support_reads, start_pos FROM fx_calls ORDER BY event_id)"""


@query("check_manifest", f"""{_EVIDENCE}
SELECT event_id AS key, 'address_repeated' AS rule FROM c WHERE FALSE
UNION ALL SELECT 'x', 'orphan_artifact'
UNION ALL SELECT CAST(start_pos % 1000 AS VARCHAR), 'dangling_artifact' FROM c WHERE start_pos % 1000 >= 990
UNION ALL SELECT event_id || '-gone', 'source_missing' FROM c WHERE start_pos % 97 = 0
UNION ALL SELECT event_id, 'chrom_differs' FROM c WHERE start_pos % 89 = 0
UNION ALL SELECT event_id, 'id_repeated' FROM c WHERE start_pos % 101 = 0
UNION ALL SELECT 'at-' || event_id, 'address_repeated' FROM c WHERE start_pos % 101 = 0
UNION ALL SELECT event_id, 'chrom_differs' FROM c WHERE start_pos % 89 = 0 AND start_pos % 101 = 0
UNION ALL SELECT CAST(start_pos % 1000 AS VARCHAR), 'dangling_artifact' FROM c WHERE start_pos % 1000 >= 990 AND start_pos % 101 = 0""")
def check_manifest(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls").dropDuplicates(["event_id"])
    p = F.col("start_pos")
    evidence = c.select(F.col("event_id").alias("id"), F.concat(F.lit("at-"), "event_id").alias("address"), (p % 1000).cast("string").alias("artifact"), "chrom", "event_type", "start_pos")
    evidence = evidence.unionByName(evidence.where(p % 101 == 0)).drop("start_pos")
    used = spark.range(990).select(F.col("id").cast("string").alias("artifact"))
    artifacts = used.join(evidence.select("artifact").distinct(), "artifact", "left_semi").union(spark.range(1).select(F.lit("x")))
    sources = F.array_compact(F.array("event_id", F.when(p % 97 == 0, F.concat("event_id", F.lit("-gone")))))
    events = c.select(F.col("event_id").alias("id"), sources.alias("sources"), F.when(p % 89 == 0, "chr0").otherwise(F.col("chrom")).alias("chrom"), "event_type")
    return validators.evidence_manifest(evidence, artifacts, events, ["chrom", "event_type"])


@query("check_events", f"""{_EVIDENCE}
SELECT event_id AS key, 'second_locus' AS rule FROM c WHERE start_pos % 31 = 0
UNION ALL SELECT event_id, 'empty_locus' FROM c WHERE start_pos % 29 = 0
UNION ALL SELECT event_id, 'confirmed_without_span' FROM c WHERE support_reads = 7""")
def check_events(spark, sf_dir):
    c = fixture(spark, sf_dir, "calls").dropDuplicates(["event_id"])
    p = F.col("start_pos")
    rows = c.select("event_id", "event_type", "start_pos", F.when(p % 29 == 0, p).otherwise(F.col("end_pos")).alias("end_pos"), F.when(p % 31 == 0, "chr1").alias("chrom2"), (F.col("support_reads") == 7).alias("span_confirmed"))
    return validators.event_contract(rows)


@query("check_report_counts", f"""WITH {sql('calls')}, r AS (SELECT chrom, count(*) FILTER (filter = 'PASS') AS a FROM fx_calls GROUP BY 1)
SELECT chrom AS key, 'counts_do_not_add_up' AS rule FROM r WHERE length(chrom) = 4 UNION ALL SELECT chrom, 'state_differs' FROM r WHERE chrom LIKE '%1' AND a > 0""")
def check_report_counts(spark, sf_dir):
    r = fixture(spark, sf_dir, "calls").groupBy("chrom").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("filter") == "PASS").alias("accepted"))
    r = r.withColumn("rejected", F.col("raw") - F.col("accepted") + F.when(F.length("chrom") == 4, 1).otherwise(0))
    return validators.report_counts(r.withColumn("state", F.when(F.col("chrom").like("%1") | (F.col("accepted") == 0), "COMPLETED_EMPTY").otherwise("COMPLETED")), "chrom")


@query("check_results", """SELECT o_orderkey || '|sv' AS key, 'events_without_completion' AS rule FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey || '|sv', 'no_reason' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey || '|cnv', 'module_repeated' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'no_quality_module' FROM orders WHERE o_orderkey % 13 = 0""")
def check_results(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    run = k.cast("string").alias("run")
    text = lambda c: c.cast("string").alias("reason")
    sv = o.select(run, F.lit("sv").alias("module"), F.when(k % 7 == 0, "FAILED").otherwise("COMPLETED").alias("state"), F.lit(3).alias("n_events"), text(F.when((k % 7 == 0) & (k % 2 == 1), "worker")))
    cnv = o.select(run, F.lit("cnv").alias("module"), F.lit("COMPLETED").alias("state"), F.lit(1).alias("n_events"), text(F.lit(None)))
    qc = o.where(k % 13 != 0).select(run, F.lit("qc").alias("module"), F.lit("COMPLETED").alias("state"), F.lit(0).alias("n_events"), text(F.lit(None)))
    return validators.result_contract(validators.together(sv, cnv, cnv.where("cast(run as long) % 11 = 0"), qc))


@query("check_dilution", """SELECT CAST(p_partkey AS VARCHAR) AS key, 'level_missing' AS rule FROM part WHERE p_partkey % 31 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'total_differs' FROM part WHERE p_partkey % 29 = 0 AND p_partkey % 31 <> 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'fraction_drifts' FROM part WHERE p_partkey % 23 = 0 AND p_partkey % 31 <> 0
UNION ALL SELECT '-1', 'level_not_planned'""")
def check_dilution(spark, sf_dir):
    k = F.col("level_id")
    plan = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("level_id")).withColumn("fraction", (k % 10) / 10).withColumn("total", F.lit(10_000))
    tumour = (F.col("fraction") * 10_000).cast("long") + F.when((k % 23 == 0) & (k % 10 < 5), 2000).when(k % 23 == 0, -2000).otherwise(0)
    done = plan.where(k % 31 != 0).select("level_id", tumour.alias("tumour_reads"), (10_000 - tumour + F.when(k % 29 == 0, 1).otherwise(0)).alias("normal_reads"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("level_id"), F.lit(0).cast("long").alias("tumour_reads"), F.lit(10_000).cast("long").alias("normal_reads"))
    return validators.dilution_consistency(plan, done.unionByName(extra), 0.05)


@query("check_metrics", """SELECT CAST(p_partkey AS VARCHAR) AS key, 'numerator_not_in_denominator' AS rule FROM part WHERE p_partkey % 37 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'excluded_in_denominator' FROM part WHERE p_partkey % 41 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'value_without_status' FROM part WHERE p_partkey % 43 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'metric_repeated' FROM part WHERE p_partkey % 47 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), r FROM part, (VALUES (37, 'numerator_not_in_denominator'), (41, 'excluded_in_denominator'), (43, 'value_without_status')) v(d, r) WHERE p_partkey % 47 = 0 AND p_partkey % d = 0""")
def check_metrics(spark, sf_dir):
    k = F.col("metric")
    m = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("metric"))
    text = lambda *x: F.array(*map(F.lit, x))
    m = m.select("metric", F.when(k % 2 == 0, "EVALUABLE").otherwise("NOT_EVALUABLE").alias("status"), F.when((k % 2 == 0) != (k % 43 == 0), 0.5).alias("value"), F.when(k % 37 == 0, text("a", "z")).otherwise(text("a")).alias("numerator"), text("a", "b", "c").alias("denominator"), F.when(k % 41 == 0, text("b")).otherwise(text("y")).alias("excluded"))
    return validators.metric_report(m.unionByName(m.where(k % 47 == 0)))


@query("check_runs", """SELECT o_orderkey || '|call' AS key, 'error_without_failure' AS rule FROM orders WHERE o_orderkey % 17 = 0
UNION ALL SELECT o_orderkey || '|call', 'time_without_run' FROM orders WHERE o_orderkey % 19 = 0
UNION ALL SELECT o_orderkey || '|call', 'negative_time' FROM orders WHERE o_orderkey % 23 = 0 AND o_orderkey % 19 <> 0
UNION ALL SELECT o_orderkey || '|plan', 'stage_repeated' FROM orders WHERE o_orderkey % 29 = 0""")
def check_runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run"))
    k = F.col("run")
    seconds = F.when(k % 19 == 0, None).when(k % 23 == 0, -1.0).otherwise(2.0)
    call = o.select("run", F.lit("call").alias("stage"), F.when(k % 3 == 0, "FAILED").otherwise("COMPLETED").alias("outcome"), F.when((k % 3 == 0) != (k % 17 == 0), "e").alias("error"), seconds.alias("seconds"))
    plan = o.select("run", F.lit("plan").alias("stage"), F.lit("COMPLETED").alias("outcome"), F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("seconds"))
    return validators.run_report(validators.together(call, plan, plan.where(k % 29 == 0)))


@query("check_scores", """WITH e AS (SELECT p_partkey AS k FROM part)
SELECT CAST(k AS VARCHAR) AS key, 'scores_differ' AS rule FROM e WHERE k % 13 = 0 OR k % 17 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'first_place_differs' FROM e WHERE k % 17 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'sum_is_not_one' FROM e WHERE k % 13 = 0 AND k % 17 <> 0""")
def check_scores(spark, sf_dir):
    k = F.col("id")
    base = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    left = base.select("id", F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1)).alias("scores"))
    other = F.when(k % 17 == 0, F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1))).when(k % 13 == 0, F.array(F.lit(0.75), F.lit(0.2), F.lit(0.1))).otherwise(F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1)))
    return validators.score_vectors(left, base.select("id", other.alias("scores")), "id", 1e-6)


@query("cohort_concordance", """SELECT count(*) AS n, count(*) FILTER (p_size % 5 <> 0 AND p_size % 7 <> 0) AS assessed, count(*) FILTER (p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 3 = p_size % 2) AS agreeing,
round(count(*) FILTER (p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 3 = p_size % 2) / nullif(count(*) FILTER (p_size % 5 <> 0 AND p_size % 7 <> 0), 0), 9) AS share FROM part""")
def cohort_concordance(spark, sf_dir):
    s = F.col("p_size")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(s % 5 != 0, s % 3).alias("expected"), F.when(s % 7 != 0, s % 2).alias("top"))
    return validators.concordance(rows)


@query("check_no_overlap", f"""WITH {sql('targets')} SELECT chrom || ':' || start_pos AS key, 'overlaps_previous' AS rule FROM (SELECT *, lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos) AS b FROM fx_targets) WHERE start_pos < b""")
def check_no_overlap(spark, sf_dir):
    return validators.no_overlap(fixture(spark, sf_dir, "targets"), "chrom")


@query("check_read_states", """SELECT CAST(user_id AS VARCHAR) AS key, 'event_type_conflict' AS rule FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def check_read_states(spark, sf_dir):
    return validators.state_conflicts(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["event_type"])
