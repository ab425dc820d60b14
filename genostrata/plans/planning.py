"""Planning, registration and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from genostrata.operators import planning
from genostrata.plans.registry import query
from genostrata.sources import sinks
from genostrata.sources.fixtures import fixture, sql, table


@query("dilution_plan", """WITH d AS (SELECT DISTINCT CAST(l_discount * 10 AS DOUBLE) AS x FROM lineitem), f AS (SELECT row_number() OVER (ORDER BY fraction DESC) - 1 AS i, fraction FROM (SELECT round(x, 1) AS fraction FROM d UNION SELECT 0.0::DOUBLE)),
t AS (SELECT CAST(min(least(CASE WHEN fraction > 0 THEN floor(100000 / fraction) ELSE 1e18 END, CASE WHEN fraction < 1 THEN floor(900000 / (1 - fraction)) ELSE 1e18 END)) AS BIGINT) AS total FROM f)
SELECT 'tf' || lpad(CAST(CAST(round_even(fraction * 10000, 0) AS INT) AS VARCHAR), 5, '0') || '_r' || r AS level_id, fraction, CAST(r AS INT) AS replicate, total, CAST(round_even(total * fraction, 0) AS BIGINT) AS tumour_reads,
       total - CAST(round_even(total * fraction, 0) AS BIGINT) AS normal_reads, CAST(7 + i * 6 + (r - 1) * 2 AS BIGINT) AS tumour_seed, CAST(8 + i * 6 + (r - 1) * 2 AS BIGINT) AS normal_seed FROM f, t, range(1, 4) x(r)""")
def dilution_plan(spark, sf_dir):
    fractions = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 10, 1).alias("fraction")).distinct()
    return planning.dilution_grid(fractions, 3, 100_000, 900_000, 7)


_CAT = "cat AS (SELECT * FROM (VALUES ('long', ['wgs', 'adaptive'], ['bam', 'reference']), ('pair', ['wgs'], ['bam', 'normal_bam', 'reference'])) v(mode, regimes, required))"


@query("caller_lane_plan", f"""WITH {_CAT}, rq AS (SELECT 'l' || c_custkey AS lane_id, CASE WHEN c_custkey % 2 = 0 THEN 'long' ELSE 'pair' END AS mode, c_custkey % 5 <> 0 AS requested, CASE WHEN c_nationkey % 3 = 0 THEN 'adaptive' ELSE 'wgs' END AS regime,
  CASE WHEN c_custkey % 4 = 3 THEN ['bam', 'normal_bam', 'reference'] ELSE ['bam', 'reference'] END AS roles, c_custkey % 7 <> 0 AS runtime FROM customer),
j AS (SELECT *, list_concat(CASE WHEN list_contains(regimes, regime) THEN [] ELSE ['regime:' || regime] END, ['missing:' || x FOR x IN list_sort(required) IF NOT list_contains(roles, x)]) AS why FROM rq JOIN cat USING (mode))
SELECT lane_id, CASE WHEN NOT requested THEN 'NOT_REQUESTED' WHEN len(why) > 0 THEN 'INELIGIBLE' WHEN NOT runtime THEN 'RUNTIME_UNAVAILABLE' ELSE 'ELIGIBLE' END AS decision, CASE WHEN requested THEN array_to_string(why, ',') ELSE 'not_requested' END AS reasons FROM j""")
def caller_lane_plan(spark, sf_dir):
    k = F.col("c_custkey")
    roles = F.when(k % 4 == 3, F.array(*map(F.lit, ("bam", "normal_bam", "reference")))).otherwise(F.array(*map(F.lit, ("bam", "reference"))))
    requests = table(spark, sf_dir, "customer").select(F.concat(F.lit("l"), k.cast("string")).alias("lane_id"), F.when(k % 2 == 0, "long").otherwise("pair").alias("mode"), (k % 5 != 0).alias("requested"), F.when(F.col("c_nationkey") % 3 == 0, "adaptive").otherwise("wgs").alias("regime"), roles.alias("roles"), (k % 7 != 0).alias("runtime"))
    catalogue = spark.createDataFrame([("long", ["wgs", "adaptive"], ["bam", "reference"]), ("pair", ["wgs"], ["bam", "normal_bam", "reference"])], "mode string, regimes array<string>, required array<string>")
    return planning.lane_plan(requests, catalogue)


@query("cohort_eligibility", """SELECT c_custkey, NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY' OR c_nationkey > 20) AS eligible,
  concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'excluded_segment' END, CASE WHEN c_nationkey > 20 THEN 'outside_region' END) AS reasons FROM customer""")
def cohort_eligibility(spark, sf_dir):
    rules = [("negative_balance", F.col("c_acctbal") < 0), ("excluded_segment", F.col("c_mktsegment") == "MACHINERY"), ("outside_region", F.col("c_nationkey") > 20)]
    return planning.eligibility(table(spark, sf_dir, "customer"), "c_custkey", rules)


@query("registered_strata", f"""WITH {sql('calls', 'contigs')}, f AS (SELECT chrom, event_type, count(*) AS n_events, count(*) FILTER (filter = 'PASS') AS n_pass FROM fx_calls GROUP BY 1, 2),
g AS (SELECT chrom, event_type FROM fx_contigs, (VALUES ('deletion'), ('duplication'), ('inversion'), ('insertion'), ('translocation')) v(event_type))
SELECT g.chrom, g.event_type, coalesce(n_events, 0) AS n_events, coalesce(n_pass, 0) AS n_pass, n_events IS NOT NULL AS evaluable FROM g LEFT JOIN f USING (chrom, event_type)""")
def registered_strata(spark, sf_dir):
    facts = fixture(spark, sf_dir, "calls").groupBy("chrom", "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("filter") == "PASS").alias("n_pass"))
    kinds = F.array(*map(F.lit, ("deletion", "duplication", "inversion", "insertion", "translocation")))
    grid = fixture(spark, sf_dir, "contigs").select("chrom", F.explode(kinds).alias("event_type"))
    return planning.with_registered(facts, grid, ["chrom", "event_type"], ["n_events", "n_pass"])


@query("id_version_fallback", """WITH a AS (SELECT 'T' || p_partkey || '.' || p_size % 3 AS id FROM part UNION ALL SELECT 'T' || p_partkey || '.9' FROM part WHERE p_partkey % 6 = 0),
b AS (SELECT 'T' || p_partkey || '.' || p_partkey % 3 AS other_id, 0 AS rank FROM part),
u AS (SELECT split_part(id, '.', 1) AS b, min(id) AS id FROM a GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT id, other_id, rank, 'full' AS how FROM b JOIN a ON id = other_id UNION ALL SELECT u.id, other_id, rank, 'unversioned' FROM b JOIN u ON split_part(other_id, '.', 1) = u.b WHERE other_id NOT IN (SELECT id FROM a))
SELECT id, other_id, how FROM x""")
def id_version_fallback(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), lambda c: F.col(c).cast("string")
    name = lambda version: F.concat(F.lit("T"), s("p_partkey"), F.lit("."), version)
    full = p.select(name((F.col("p_size") % 3).cast("string")).alias("id")).union(p.where("p_partkey % 6 = 0").select(name(F.lit("9"))))
    other = p.select(name((F.col("p_partkey") % 3).cast("string")).alias("other_id"), F.lit(0).alias("rank"))
    return planning.matched_ids(full, other)


@query("calibration_split", f"""WITH {sql('reads')}, k AS (SELECT source, read_name, row_number() OVER (PARTITION BY source ORDER BY md5('5|' || read_name), read_name) AS r, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, read_name FROM fx_reads))
SELECT source, read_name, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.25, 0))) THEN 'reference' ELSE 'mixture' END AS part FROM k""")
def calibration_split(spark, sf_dir):
    return planning.split_by_hash(fixture(spark, sf_dir, "reads"), "read_name", "source", 0.25, 5)


@query("run_alerts", """WITH r AS (SELECT 'run' || c_custkey AS run, CASE c_nationkey % 3 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict, CASE c_custkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NO_CALL' ELSE 'COMPLETED' END AS status, c_custkey % 6 AS n_events FROM customer)
SELECT run, CASE verdict WHEN 'FAIL' THEN 'critical' ELSE 'warning' END AS level, CASE verdict WHEN 'FAIL' THEN 'QC failed' ELSE 'QC warning' END AS title FROM r WHERE verdict <> 'PASS'
UNION ALL SELECT run, CASE status WHEN 'FAILED' THEN 'critical' ELSE 'warning' END, 'sv: ' || status FROM r WHERE status <> 'COMPLETED' UNION ALL SELECT run, 'info', 'No events' FROM r WHERE n_events = 0""")
def run_alerts(spark, sf_dir):
    k = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(F.concat(F.lit("run"), k.cast("string")).alias("run"), F.when(F.col("c_nationkey") % 3 == 0, "FAIL").when(F.col("c_nationkey") % 3 == 1, "WARN").otherwise("PASS").alias("verdict"), F.lit("sv").alias("module"), F.when(k % 4 == 0, "FAILED").when(k % 4 == 1, "NO_CALL").otherwise("COMPLETED").alias("status"), (k % 6).alias("n_events"))
    return planning.alerts(runs)


@query("stage_signatures", """WITH s AS (SELECT n_nationkey, n_name, list_sort(list(sha256(r_name)) OVER (PARTITION BY n_regionkey)) AS up FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, sha256(n_name || chr(10) || array_to_string(up, ',') || chr(10) || 'k=' || n_nationkey % 4) AS signature FROM s""")
def stage_signatures(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    upstream = F.collect_list(F.sha2("r_name", 256)).over(Window.partitionBy("n_regionkey"))
    return n.select("n_nationkey", "n_name", upstream.alias("up")).select("n_nationkey", planning.stage_signature(F.col("n_name"), F.col("up"), F.concat(F.lit("k="), (F.col("n_nationkey") % 4).cast("string"))).alias("signature"))


@query("sidecar_fingerprint", f"""WITH {sql('targets')}, d AS (SELECT sha256(concat_ws('|', target_id, chrom, start_pos, end_pos, label, CAST(round(mean_depth * 1000000) AS BIGINT))) AS h FROM fx_targets)
SELECT count(*) AS n_rows, 'target_id,chrom,start_pos,end_pos,label,micro_depth' AS columns, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM d""")
def sidecar_fingerprint(spark, sf_dir):
    t = fixture(spark, sf_dir, "targets")
    return sinks.fingerprint(t.select("target_id", "chrom", "start_pos", "end_pos", "label", F.round(F.col("mean_depth") * 1000000).cast("long").alias("micro_depth")))


# A plan for each order: its lines by supplier and part as lanes, each after some of those of lesser number.
_LANES = """n AS (SELECT DISTINCT l_orderkey::VARCHAR AS plan, l_linenumber AS i, min(lpad((l_suppkey % 50)::VARCHAR, 2, '0') || '-' || l_linenumber) AS node, min(l_partkey)::VARCHAR AS payload FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT c.plan, p.node AS parent, c.node AS child FROM n p JOIN n c ON p.plan = c.plan AND p.i < c.i AND (p.i * 2 = c.i OR (c.i - p.i = 3 AND length(c.payload) > 2)))"""


@query("lane_order", f"""WITH RECURSIVE {_LANES},
up AS (SELECT plan, child AS node, list(parent ORDER BY parent) AS parents FROM e GROUP BY plan, child),
x AS (SELECT n.plan, n.node, n.payload, coalesce(parents, []) AS parents FROM n LEFT JOIN up ON up.plan = n.plan AND up.node = n.node),
l AS (SELECT plan, list({{'node': node, 'payload': payload, 'parents': parents}} ORDER BY node) AS all_nodes FROM x GROUP BY plan),
w(plan, all_nodes, done, hashes, k) AS (SELECT plan, all_nodes, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0 FROM l
  UNION ALL SELECT plan, all_nodes, list_append(done, nxt.node), list_append(hashes, sha256(array_to_string(list_concat([nxt.node, nxt.payload], list_transform(nxt.parents, lambda p: p || '=' || hashes[list_position(done, p)])), chr(10)))), k + 1
  FROM (SELECT *, list_filter(all_nodes, lambda y: NOT list_contains(done, y.node) AND list_has_all(done, y.parents))[1] AS nxt FROM w WHERE k < len(all_nodes)))
SELECT plan, done[k] AS node, k AS place, hashes[k] AS hash FROM w WHERE k > 0""")
def lane_order(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("plan", F.col("l_orderkey").cast("string"))
    name = F.concat(F.lpad((F.col("l_suppkey") % 50).cast("string"), 2, "0"), F.lit("-"), F.col("l_linenumber").cast("string"))
    n = items.groupBy("plan", F.col("l_linenumber").alias("i")).agg(F.min(name).alias("node"), F.min("l_partkey").cast("string").alias("payload"))
    p, c = n.select("plan", F.col("i").alias("pi"), F.col("node").alias("parent")), n.select("plan", F.col("i").alias("ci"), F.col("node").alias("child"), "payload")
    after = (F.col("pi") * 2 == F.col("ci")) | ((F.col("ci") - F.col("pi") == 3) & (F.length("payload") > 2))
    edges = p.join(c, "plan").where((F.col("pi") < F.col("ci")) & after).select("plan", "parent", "child")
    return planning.ordered_lanes(n.select("plan", "node", "payload"), edges)
