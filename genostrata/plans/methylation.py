"""Methylation, mixture and quantitation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from genostrata.functions import labels, stats
from genostrata.operators import methylation, mixture
from genostrata.plans.registry import query
from genostrata.sources.fixtures import fixture, sql


@query("site_region_summary", f"""WITH {sql('sites', 'targets')},
g AS (SELECT target_id, chrom, start_pos, end_pos, code FROM fx_targets, (VALUES ('m'), ('h')) v(code))
SELECT g.target_id, g.code, count(s.site_id) AS n_sites, count(*) FILTER (s.valid_coverage >= 5) AS n_used,
       CAST(coalesce(sum(s.valid_coverage) FILTER (s.valid_coverage >= 5), 0) AS BIGINT) AS valid, CAST(coalesce(sum(s.modified_calls) FILTER (s.valid_coverage >= 5), 0) AS BIGINT) AS modified,
       round(sum(s.modified_calls) FILTER (s.valid_coverage >= 5) / sum(s.valid_coverage) FILTER (s.valid_coverage >= 5), 9) AS mean_fraction,
       round(median(s.modified_calls / s.valid_coverage) FILTER (s.valid_coverage >= 5), 9) AS median_fraction
FROM g LEFT JOIN fx_sites s ON s.chrom = g.chrom AND s.code = g.code AND s.pos >= g.start_pos AND s.pos < g.end_pos GROUP BY 1, 2""")
def site_region_summary(spark, sf_dir):
    return methylation.region_summary(fixture(spark, sf_dir, "sites"), fixture(spark, sf_dir, "targets"), ("m", "h"), 5)


@query("site_position_totals", f"""WITH {sql('sites')}, p AS (SELECT chrom, pos, max(valid_coverage) AS v, count(DISTINCT valid_coverage) > 1 AS differ FROM fx_sites GROUP BY 1, 2)
SELECT chrom, count(*) AS n_positions, count(*) FILTER (differ) AS n_disagreeing, CAST(sum(v) AS BIGINT) AS valid FROM p GROUP BY chrom""")
def site_position_totals(spark, sf_dir):
    return methylation.position_totals(fixture(spark, sf_dir, "sites"))


@query("haplotype_split", f"""WITH {sql('sites')}, s AS (SELECT chrom, code, site_id % 3 AS hp, sum(valid_coverage) AS v, sum(modified_calls) AS m FROM fx_sites GROUP BY ALL),
p AS (SELECT chrom, code, max(m / v) FILTER (hp = 1) AS a, max(m / v) FILTER (hp = 2) AS b, max(m / v) FILTER (hp = 0) AS c FROM s GROUP BY 1, 2)
SELECT chrom, code, round(a, 9) AS hp1, round(b, 9) AS hp2, round(c, 9) AS unphased, round(a - b, 9) AS difference FROM p""")
def haplotype_split(spark, sf_dir):
    return methylation.haplotype_table(fixture(spark, sf_dir, "sites").withColumn("hp", (F.col("site_id") % 3).cast("int")))


@query("unphased_remainder", f"""WITH {sql('sites')}, c AS (SELECT chrom, pos // 50000 AS pos, code, sum(valid_coverage) AS v, sum(modified_calls) AS m, sum(valid_coverage) FILTER (site_id % 3 <> 0) AS pv, sum(modified_calls) FILTER (site_id % 3 <> 0) AS pm FROM fx_sites GROUP BY 1, 2, 3)
SELECT chrom, pos, code, CAST(v - coalesce(pv, 0) AS BIGINT) AS valid, CAST(m - coalesce(pm, 0) AS BIGINT) AS modified, v - coalesce(pv, 0) < 0 OR m - coalesce(pm, 0) < 0 AS negative_count FROM c WHERE v - coalesce(pv, 0) <> 0 OR m - coalesce(pm, 0) <> 0""")
def unphased_remainder(spark, sf_dir):
    s = fixture(spark, sf_dir, "sites").withColumn("pos", F.expr("pos div 50000"))
    return methylation.unphased(s, s.where("site_id % 3 <> 0"))


_POOL = """p AS (SELECT 'cg' || (pos // 2500) % 500 AS probe, sum(valid_coverage) AS valid, sum(modified_calls) AS modified FROM fx_sites GROUP BY 1 HAVING sum(valid_coverage) > 0)"""


def pooled(spark, sf_dir):
    sites = fixture(spark, sf_dir, "sites").withColumn("pos_key", F.expr("pos div 2500"))
    probes = sites.select("chrom", "pos_key").distinct().withColumn("probe", F.concat(F.lit("cg"), (F.col("pos_key") % 500).cast("string")))
    return methylation.probe_pool(sites, probes)


@query("probe_pool", f"WITH {sql('sites')}, {_POOL} SELECT probe, CAST(valid AS BIGINT) AS valid, CAST(modified AS BIGINT) AS modified, round(modified / valid, 9) AS beta FROM p")
def probe_pool(spark, sf_dir):
    return pooled(spark, sf_dir)


@query("feature_vector", f"""WITH {sql('sites')}, {_POOL}
SELECT i AS ord, 'cg' || i AS feature, CAST(CASE WHEN modified / valid >= 0.5 THEN 1 WHEN modified / valid < 0.5 THEN -1 ELSE 0 END AS INT) AS value FROM range(600) r(i) LEFT JOIN p ON p.probe = 'cg' || i""")
def feature_vector(spark, sf_dir):
    features = spark.range(600).select(F.col("id").alias("ord"), F.concat(F.lit("cg"), F.col("id").cast("string")).alias("feature"))
    return methylation.feature_vector(features, pooled(spark, sf_dir))


@query("class_rollup", f"""WITH {sql('targets')}, s AS (SELECT label AS class, 'F' || target_id % 5 AS family, 'L' || target_id % 2 AS lineage, mean_depth / (SELECT sum(mean_depth) FROM fx_targets) AS score FROM fx_targets),
g AS (SELECT 'class' AS level, class AS label, sum(score) AS score FROM s GROUP BY 2 UNION ALL SELECT 'family', family, sum(score) FROM s GROUP BY 2 UNION ALL SELECT 'lineage', lineage, sum(score) FROM s GROUP BY 2),
r AS (SELECT level, label, round(score, 9) AS score, row_number() OVER (PARTITION BY level ORDER BY round(score, 9) DESC, label) AS rank FROM g)
SELECT *, CASE WHEN rank = 1 AND score >= 0.8 THEN 'HIGH_CONFIDENCE' WHEN rank = 1 THEN 'TOP' END AS call FROM r""")
def class_rollup(spark, sf_dir):
    t = fixture(spark, sf_dir, "targets")
    total = t.agg(F.sum("mean_depth").alias("total"))
    s = t.join(F.broadcast(total), F.lit(True)).select(F.col("label").alias("class"), F.concat(F.lit("F"), (F.col("target_id") % 5).cast("string")).alias("family"), F.concat(F.lit("L"), (F.col("target_id") % 2).cast("string")).alias("lineage"), (F.col("mean_depth") / F.col("total")).alias("score"))
    return methylation.class_rollup(s)


_CALLS = """d AS (SELECT * FROM fx_reads QUALIFY row_number() OVER (PARTITION BY read_name, marker_id ORDER BY event_id DESC) = 1),
st AS (SELECT *, CASE WHEN llr >= 2.5 * num_motifs THEN 'M' WHEN llr <= -2.5 * num_motifs THEN 'U' ELSE 'A' END AS s FROM d),
k AS (SELECT source, marker_id, count(*) FILTER (s = 'M') AS m, count(*) FILTER (s = 'U') AS u, count(*) FILTER (s = 'A') AS a FROM st GROUP BY 1, 2)"""
_MARKERS = f"""{_CALLS}, mk AS (SELECT *, ma / (ma + ua) - mb / (mb + ub) AS delta FROM (SELECT x.marker_id, x.m AS ma, x.u AS ua, y.m AS mb, y.u AS ub FROM k x JOIN k y USING (marker_id) WHERE x.source = 'A' AND y.source = 'B') WHERE ma + ua >= 5 AND mb + ub >= 5),
top AS (SELECT * FROM mk WHERE abs(delta) >= 0.01 - 1e-12 ORDER BY abs(round(delta, 12)) DESC, marker_id LIMIT 20)"""


def counts(spark, sf_dir):
    return mixture.marker_counts(mixture.deduplicated(fixture(spark, sf_dir, "reads")))


@query("marker_counts", f"WITH {sql('reads')}, {_CALLS} SELECT source, marker_id, m, u, a, round(m / nullif(m + u, 0), 9) AS beta FROM k")
def marker_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query("reference_markers", f"WITH {sql('reads')}, {_MARKERS} SELECT marker_id, ma, ua, mb, ub, round(delta, 9) AS delta FROM top")
def reference_markers(spark, sf_dir):
    return mixture.reference_markers(counts(spark, sf_dir), 5, 0.01, 20).withColumn("delta", F.round("delta", 9))


def levels(spark, sf_dir):
    """Mixtures: all calls of reads whose number has a given last digit."""
    reads = mixture.deduplicated(fixture(spark, sf_dir, "reads")).withColumn("level", F.concat(F.lit("d"), F.substring("read_name", -1, 1)))
    state = mixture.call_state(F.col("llr"), F.col("num_motifs"))
    return reads.withColumn("s", state).groupBy("level", "marker_id").agg(F.count_if(F.col("s") == "M").alias("m"), F.count_if(F.col("s") == "U").alias("u"))


_LEVELS = f"""{_MARKERS}, lv AS (SELECT 'd' || right(read_name, 1) AS level, marker_id, count(*) FILTER (s = 'M') AS mo, count(*) FILTER (s = 'U') AS uo FROM st GROUP BY 1, 2),
x AS (SELECT level, ma / (ma + ua) - mb / (mb + ub) AS d, mo / (mo + uo) - mb / (mb + ub) AS r,
  1 / greatest((ma + 0.5) * (ua + 0.5) / ((ma + ua + 1.0) * (ma + ua + 1.0) * (ma + ua + 2.0)) + (mb + 0.5) * (ub + 0.5) / ((mb + ub + 1.0) * (mb + ub + 1.0) * (mb + ub + 2.0)) + (mo + 0.5) * (uo + 0.5) / ((mo + uo + 1.0) * (mo + uo + 1.0) * (mo + uo + 2.0)), 1e-12) AS w
  FROM lv JOIN top USING (marker_id) WHERE mo + uo > 0),
f AS (SELECT level, count(*) AS n_markers, sum(w * d * r) / nullif(sum(w * d * d), 0) AS raw FROM x GROUP BY level),
e AS (SELECT f.level, n_markers, raw, greatest(0.0, least(1.0, raw)) AS fraction, sqrt(sum(w * (r - raw * d) ** 2) / greatest(n_markers - 1, 1)) AS rmse FROM f JOIN x ON f.level = x.level GROUP BY f.level, n_markers, raw)"""


@query("mixture_point_estimate", f"WITH {sql('reads')}, {_LEVELS} SELECT level, n_markers, round(raw, 6) AS raw, round(fraction, 6) AS fraction, round(rmse, 6) AS rmse FROM e")
def mixture_point_estimate(spark, sf_dir):
    markers = mixture.reference_markers(counts(spark, sf_dir), 5, 0.01, 20)
    return mixture.point_estimate(markers, levels(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("raw", "fraction", "rmse")})


@query("mixture_draws")
def mixture_draws(spark, sf_dir):
    markers = mixture.reference_markers(counts(spark, sf_dir), 5, 0.01, 20)
    unclear = counts(spark, sf_dir).groupBy("marker_id").agg(*[F.sum(F.when(F.col("source") == x.upper(), F.col("a")).otherwise(0)).alias(f"a{x}") for x in "ab"])
    return mixture.interval_draws(markers.join(unclear, "marker_id"), levels(spark, sf_dir))


@query("mixture_gates", f"""WITH {sql('reads')}, {_LEVELS}, n AS (SELECT count(*) AS n FROM top),
g AS (SELECT level, CASE WHEN n < 10 THEN 'few_reference_markers' WHEN n_markers < 10 OR raw IS NULL THEN 'few_markers_used' WHEN raw < -0.1 OR raw > 1.1 THEN 'extrapolated' WHEN rmse > 0.8 THEN 'poor_fit' END AS reason FROM e, n)
SELECT level, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'NO_CALL' END AS status, reason FROM g""")
def mixture_gates(spark, sf_dir):
    markers = mixture.reference_markers(counts(spark, sf_dir), 5, 0.01, 20)
    estimates = mixture.point_estimate(markers, levels(spark, sf_dir))
    return mixture.level_gates(estimates, markers.agg(F.count(F.lit(1)).alias("n")), min_markers=10, max_rmse=0.8)


@query("recovery_metrics", f"""WITH {sql('reads')}, {_LEVELS}, t AS (SELECT 'd' || i AS level, i / 11.0 AS truth FROM range(12) r(i))
SELECT count(*) AS expected, count(fraction) AS completed, round(avg(fraction - truth), 6) AS bias, round(avg(abs(fraction - truth)), 6) AS mae, round(sqrt(avg((fraction - truth) ** 2)), 6) AS rmse, round(1 - count(fraction) / count(*), 6) AS no_call_rate FROM t LEFT JOIN e USING (level)""")
def recovery_metrics(spark, sf_dir):
    markers = mixture.reference_markers(counts(spark, sf_dir), 5, 0.01, 20)
    truth = spark.range(12).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("level"), (F.col("id") / 11.0).alias("truth"))
    return mixture.recovery(mixture.point_estimate(markers, levels(spark, sf_dir)), truth).withColumns({c: F.round(c, 6) for c in ("bias", "mae", "rmse", "no_call_rate")})


_Z = "1.959963984540054"


def _wilson(k, n):
    centre, spread = f"(({k} + {_Z} * {_Z} / 2) / ({n} + {_Z} * {_Z}))", f"({_Z} / ({n} + {_Z} * {_Z}) * sqrt({k} * ({n} - {k}) / {n} + {_Z} * {_Z} / 4))"
    return f"greatest(0.0, {centre} - {spread})", f"least(1.0, {centre} + {spread})"


_ALLELES = "al AS (SELECT event_id, least(support_reads, 18) AS k, 10 + support_reads AS n, filter = 'PASS' AS neutral FROM fx_calls)"
_W = _wilson("k", "n")


def alleles(spark, sf_dir):
    return fixture(spark, sf_dir, "calls").select("event_id", F.least("support_reads", F.lit(18)).alias("k"), (F.col("support_reads") + 10).alias("n"), (F.col("filter") == "PASS").alias("neutral"), "vaf")


@query("wilson", f"WITH {sql('calls')}, {_ALLELES} SELECT event_id, round({_W[0]}, 9) AS low, round({_W[1]}, 9) AS high FROM al")
def wilson(spark, sf_dir):
    w = stats.wilson(F.col("k"), F.col("n"))
    return alleles(spark, sf_dir).select("event_id", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


def _doubled(scale):
    return f"""CASE WHEN NOT neutral THEN 'not_copy_neutral' WHEN n < 20 THEN 'depth_too_low' WHEN k = 0 THEN 'no_variant_reads' WHEN k / n * {scale} > 1 THEN 'vaf_exceeds_model' ELSE 'determinable' END AS status"""


@query("tumour_fraction", f"WITH {sql('calls')}, {_ALLELES}, s AS (SELECT *, {_doubled('2.0')} FROM al) SELECT event_id, status, round(CASE WHEN status = 'determinable' THEN k / n * 2.0 END, 9) AS point, round(CASE WHEN status = 'determinable' THEN least(1.0, 2.0 * {_W[0]}) END, 9) AS low, round(CASE WHEN status = 'determinable' THEN least(1.0, 2.0 * {_W[1]}) END, 9) AS high FROM s")
def tumour_fraction(spark, sf_dir):
    e = alleles(spark, sf_dir).select("event_id", stats.doubled_fraction(F.col("k"), F.col("n"), F.col("neutral"), F.lit(2.0)).alias("e"))
    return e.select("event_id", "e.status", *[F.round(f"e.{c}", 9).alias(c) for c in ("point", "low", "high")])


@query("ccf", f"WITH {sql('calls')}, {_ALLELES}, s AS (SELECT *, {_doubled('2.5')} FROM al) SELECT event_id, status, round(CASE WHEN status = 'determinable' THEN k / n * 2.5 END, 9) AS point FROM s")
def ccf(spark, sf_dir):
    e = alleles(spark, sf_dir).select("event_id", stats.doubled_fraction(F.col("k"), F.col("n"), F.col("neutral"), F.lit(2 / 0.8)).alias("e"))
    return e.select("event_id", "e.status", F.round("e.point", 9).alias("point"))


@query("copy_number_from_ratio", f"WITH {sql('calls')} SELECT event_id, round(CASE WHEN copy_number / 2 * vaf * 10 >= 0.4 THEN (2 * (copy_number / 2 * vaf * 10) - 0.8) / 0.6 END, 9) AS tumour_cn, round(vaf * 0.6 / 2, 9) AS expected_vaf FROM fx_calls")
def copy_number_from_ratio(spark, sf_dir):
    ratio = F.col("copy_number") / 2 * F.col("vaf") * 10
    return fixture(spark, sf_dir, "calls").select("event_id", F.round(stats.copy_number_from_ratio(ratio, F.lit(0.6)), 9).alias("tumour_cn"), F.round(stats.expected_vaf(F.lit(0.6), F.col("vaf")), 9).alias("expected_vaf"))


_MINREADS = """tail AS (SELECT depth, k, (SELECT sum(exp(lgamma(depth + 1) - lgamma(i + 1) - lgamma(depth - i + 1) + i * ln(0.01) + (depth - i) * ln(0.99))) FROM range(k, depth + 1) r(i)) AS p FROM (SELECT depth, unnest(range(1, depth + 1)) AS k FROM depths)),
mr AS (SELECT d.depth, coalesce(min(k) FILTER (p <= 0.01), d.depth + 1) AS min_reads FROM depths d LEFT JOIN tail t ON t.depth = d.depth GROUP BY d.depth)"""


@query("binomial_min_reads", f"WITH {sql('calls')}, depths AS (SELECT DISTINCT 10 + support_reads AS depth FROM fx_calls), {_MINREADS} SELECT depth, CAST(min_reads AS INT) AS min_reads FROM mr")
def binomial_min_reads(spark, sf_dir):
    return stats.min_variant_reads(alleles(spark, sf_dir).select(F.col("n").alias("depth")), 0.01, 0.01)


@query("small_variant_policy", f"""WITH {sql('calls')}, {_ALLELES}, depths AS (SELECT DISTINCT n AS depth FROM al), {_MINREADS}
SELECT event_id, CASE WHEN NOT neutral THEN 'not_pass' WHEN n < 30 THEN 'low_depth' WHEN k < 4 THEN 'few_variant_reads' WHEN min_reads > n THEN 'unresolvable_depth' WHEN k / n < min_reads / n THEN 'below_detection_floor' END AS reason FROM al JOIN mr ON depth = n""")
def small_variant_policy(spark, sf_dir):
    a = alleles(spark, sf_dir)
    floor = stats.min_variant_reads(a.select(F.col("n").alias("depth")), 0.01, 0.01)
    rows = a.join(floor, a["n"] == floor["depth"])
    reason = labels.small_variant_reason(passed=F.col("neutral"), depth=F.col("n"), reads=F.col("k"), min_reads=F.col("min_reads"))
    return rows.select("event_id", reason.alias("reason"))
