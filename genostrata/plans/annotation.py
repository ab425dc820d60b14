"""Annotation, segment, audit and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genostrata.functions.evidence import first_reason
from genostrata.operators import annotate, audit, metrics, segments
from genostrata.plans.registry import query
from genostrata.sources.fixtures import fixture, sql, table

_TX = """tx AS (SELECT 't' || target_id AS transcript_id, label AS gene_id, chrom, start_pos, end_pos,
  CASE target_id % 10 WHEN 0 THEN 'MANE Select' WHEN 1 THEN 'MANE Plus Clinical' END AS mane_status, target_id % 7 = 0 AS is_canonical,
  CASE WHEN target_id % 6 = 0 THEN 'appris_principal_1' END AS appris, CASE WHEN target_id % 3 = 0 THEN 'protein_coding' ELSE 'lncRNA' END AS transcript_type, target_id % 4 = 0 AS is_basic,
  (end_pos - start_pos) // 3 AS cds_length, end_pos - start_pos AS transcript_length FROM fx_targets)"""


def transcripts(spark, sf_dir) -> DataFrame:
    k = F.col("target_id")
    length = F.col("end_pos") - F.col("start_pos")
    return fixture(spark, sf_dir, "targets").select(
        F.concat(F.lit("t"), k.cast("string")).alias("transcript_id"), F.col("label").alias("gene_id"), "chrom", "start_pos", "end_pos",
        F.when(k % 10 == 0, "MANE Select").when(k % 10 == 1, "MANE Plus Clinical").alias("mane_status"), (k % 7 == 0).alias("is_canonical"),
        F.when(k % 6 == 0, "appris_principal_1").alias("appris"), F.when(k % 3 == 0, "protein_coding").otherwise("lncRNA").alias("transcript_type"), (k % 4 == 0).alias("is_basic"),
        F.expr("(end_pos - start_pos) div 3").alias("cds_length"), length.alias("transcript_length"))


@query("transcript_rank", f"""WITH {sql('targets')}, {_TX}, r AS (SELECT transcript_id, gene_id, CASE WHEN mane_status = 'MANE Select' THEN 0 WHEN mane_status = 'MANE Plus Clinical' THEN 1 WHEN is_canonical OR coalesce(appris, '') LIKE 'appris_principal%' THEN 2 WHEN transcript_type = 'protein_coding' OR is_basic THEN 3 ELSE 4 END AS tier, cds_length, transcript_length FROM tx)
SELECT transcript_id, CAST(tier AS INT) AS tier, row_number() OVER w AS rank, row_number() OVER w = 1 AS preferred FROM r WINDOW w AS (PARTITION BY gene_id ORDER BY tier, cds_length DESC, transcript_length DESC, transcript_id)""")
def transcript_rank(spark, sf_dir):
    return annotate.ranked_transcripts(transcripts(spark, sf_dir)).select("transcript_id", "tier", "rank", "preferred")


@query("exon_intron", f"""WITH {sql('sites', 'targets')}, {_TX},
ex AS (SELECT transcript_id, chrom, CAST(i AS INT) AS exon_number, CASE WHEN length(transcript_id) % 2 = 0 THEN start_pos + (i - 1) * 1000 ELSE end_pos - (i - 1) * 1000 - 500 END AS s, CASE WHEN length(transcript_id) % 2 = 0 THEN start_pos + (i - 1) * 1000 + 500 ELSE end_pos - (i - 1) * 1000 END AS e FROM tx, range(1, 4) r(i) WHERE i * 1000 <= end_pos - start_pos),
gap AS (SELECT transcript_id, chrom, least(e, e2) AS s, greatest(s, s2) AS e, least(exon_number, n2) AS n FROM (SELECT *, lead(exon_number) OVER w AS n2, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM ex WINDOW w AS (PARTITION BY transcript_id ORDER BY exon_number)) WHERE n2 IS NOT NULL),
span AS (SELECT transcript_id, chrom, min(s) AS s, max(e) AS e FROM ex GROUP BY 1, 2),
h AS (SELECT p.site_id, x.transcript_id, 0 AS kind, exon_number AS n FROM fx_sites p JOIN ex x ON p.chrom = x.chrom AND p.pos >= x.s AND p.pos < x.e
  UNION ALL SELECT p.site_id, x.transcript_id, 1, n FROM fx_sites p JOIN gap x ON p.chrom = x.chrom AND p.pos >= x.s AND p.pos < x.e
  UNION ALL SELECT p.site_id, x.transcript_id, 2, NULL FROM fx_sites p JOIN span x ON p.chrom = x.chrom AND p.pos >= x.s AND p.pos < x.e),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id, transcript_id ORDER BY kind, n) AS k FROM h)
SELECT site_id AS point_id, transcript_id, CASE kind WHEN 0 THEN 'exon' WHEN 1 THEN 'intron' ELSE 'transcript' END AS part, CAST(n AS INT) AS number FROM b WHERE k = 1""")
def exon_intron(spark, sf_dir):
    t = transcripts(spark, sf_dir).withColumn("exon_number", F.explode(F.sequence(F.lit(1), F.lit(3)))).where("exon_number * 1000 <= end_pos - start_pos")
    forward = F.length("transcript_id") % 2 == 0
    step = (F.col("exon_number") - 1) * 1000
    first = F.when(forward, F.col("start_pos") + step).otherwise(F.col("end_pos") - step - 500)
    exons = t.select("transcript_id", "chrom", "exon_number", first.alias("start_pos"), (first + 500).alias("end_pos"))
    points = fixture(spark, sf_dir, "sites").select(F.col("site_id").alias("point_id"), F.col("chrom").alias("l_chrom"), F.col("pos").alias("l_pos"))
    return annotate.exon_or_intron(points, exons)


_BANDS = """bands AS (SELECT chrom, i * 100000 AS s, (i + 1) * 100000 AS e, CASE WHEN i < 20 THEN 'p' ELSE 'q' END || i AS band, i + 1 AS band_index FROM fx_contigs, range(52) r(i)),
segs AS (SELECT event_id, chrom, start_pos AS s, start_pos + (end_pos - start_pos) * 200 AS e, CASE WHEN event_type = 'deletion' THEN 'loss' ELSE 'gain' END AS direction FROM fx_calls WHERE event_type IN ('deletion', 'duplication')),
ov AS (SELECT event_id, g.chrom, direction, band, band_index, least(g.e, b.e) - greatest(g.s, b.s) AS bp, (least(g.e, b.e) - greatest(g.s, b.s)) / (b.e - b.s) AS fraction FROM segs g JOIN bands b ON g.chrom = b.chrom AND g.s < b.e AND b.s < g.e)"""


def overlaps(spark, sf_dir) -> DataFrame:
    contigs = fixture(spark, sf_dir, "contigs").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(51))))
    bands = contigs.select("chrom", (F.col("i").cast("long") * 100000).alias("start_pos"), ((F.col("i").cast("long") + 1) * 100000).alias("end_pos"), F.concat(F.when(F.col("i") < 20, "p").otherwise("q"), F.col("i").cast("string")).alias("band"))
    calls = fixture(spark, sf_dir, "calls").where("event_type IN ('deletion', 'duplication')")
    segs = calls.select("event_id", "chrom", "start_pos", (F.col("start_pos") + (F.col("end_pos") - F.col("start_pos")) * 200).alias("end_pos"), F.when(F.col("event_type") == "deletion", "loss").otherwise("gain").alias("direction"))
    return annotate.band_overlaps(segs, bands, 0.66)


@query("cytoband_affected", f"WITH {sql('calls', 'contigs')}, {_BANDS} SELECT event_id, chrom, direction, band, band_index, bp AS overlap_bp, round(fraction, 9) AS fraction, fraction >= 0.66 AS affected FROM ov")
def cytoband_affected(spark, sf_dir):
    return overlaps(spark, sf_dir).withColumn("fraction", F.round("fraction", 9))


@query("cytoband_groups", f"""WITH {sql('calls', 'contigs')}, {_BANDS}, h AS (SELECT DISTINCT chrom, direction, band_index FROM ov WHERE fraction >= 0.66),
i AS (SELECT *, band_index - row_number() OVER (PARTITION BY chrom, direction ORDER BY band_index) AS island FROM h)
SELECT chrom, direction, min(band_index) AS first_index, max(band_index) AS last_index, count(*) AS n_bands FROM i GROUP BY chrom, direction, island""")
def cytoband_groups(spark, sf_dir):
    return annotate.band_groups(overlaps(spark, sf_dir))


_BINS = """bins AS (SELECT chrom, site_id AS bin, pos AS start_pos, pos + 1000 AS end_pos, CAST(CASE (site_id // 200) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS DOUBLE) AS call, 2.0 + ((site_id // 200) % 3) * 0.5 AS copy_number FROM fx_sites),
runs AS (SELECT *, sum(edge) OVER (PARTITION BY chrom ORDER BY bin) AS run FROM (SELECT *, CASE WHEN lag(call) OVER w IS DISTINCT FROM call OR lag(copy_number) OVER w IS DISTINCT FROM copy_number THEN 1 ELSE 0 END AS edge FROM bins WINDOW w AS (PARTITION BY chrom ORDER BY bin))),
seg AS (SELECT chrom, run, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS bin_count, median(copy_number) AS copy_number, median(call) AS call FROM runs GROUP BY chrom, run)"""


def collapsed(spark, sf_dir) -> DataFrame:
    block = F.expr("(site_id div 200) % 3")
    bins = fixture(spark, sf_dir, "sites").select("chrom", F.col("site_id").alias("bin"), F.col("pos").alias("start_pos"), (F.col("pos") + 1000).alias("end_pos"), F.when(block == 0, 0.0).when(block == 1, 1.0).otherwise(-1.0).alias("call"), (F.lit(2.0) + block * 0.5).alias("copy_number"))
    return segments.collapse(bins)


@query("segment_runs", f"WITH {sql('sites')}, {_BINS} SELECT chrom, start_pos, end_pos, bin_count, copy_number, call FROM seg")
def segment_runs(spark, sf_dir):
    return collapsed(spark, sf_dir)


@query("weighted_chrom_median", f"""WITH {sql('targets')}, s AS (SELECT chrom, mean_depth AS v, end_pos - start_pos AS w, min(end_pos - start_pos) OVER (PARTITION BY chrom) AS lw FROM fx_targets),
x AS (SELECT chrom, v, unnest(range(CAST(greatest(1, round_even(w / lw, 0)) AS BIGINT))) AS i FROM s) SELECT chrom, round(median(v), 9) AS copy_number FROM x GROUP BY chrom""")
def weighted_chrom_median(spark, sf_dir):
    s = fixture(spark, sf_dir, "targets").select("chrom", "start_pos", "end_pos", F.col("mean_depth").alias("copy_number"))
    return segments.weighted_medians(s).withColumn("copy_number", F.round("copy_number", 9))


@query("cn_consensus", f"""WITH {sql('targets')}, b AS (SELECT chrom, target_id % 5 AS size, avg(mean_depth) / 12 AS cn FROM fx_targets GROUP BY 1, 2),
m AS (SELECT chrom, median(cn) AS median_cn, CAST(round_even(median(cn), 0) AS INT) AS rounded_cn FROM b GROUP BY chrom)
SELECT m.chrom, round(median_cn, 9) AS median_cn, rounded_cn, count(*) FILTER (CAST(round_even(cn, 0) AS INT) = rounded_cn) AS agreeing, count(*) AS contributing, round(min(cn), 9) AS min_cn, round(max(cn), 9) AS max_cn FROM m JOIN b USING (chrom) GROUP BY ALL""")
def cn_consensus(spark, sf_dir):
    b = fixture(spark, sf_dir, "targets").groupBy("chrom", (F.col("target_id") % 5).alias("size")).agg((F.avg("mean_depth") / 12).alias("copy_number"))
    return segments.consensus(b).withColumns({c: F.round(c, 9) for c in ("median_cn", "min_cn", "max_cn")})


_TYPED = f"""{_BINS}, ty AS (SELECT s.chrom, start_pos, end_pos, copy_number, coalesce((end_pos - start_pos) / length, 0) AS fraction, length,
  CASE WHEN coalesce((end_pos - start_pos) / length, 0) >= 0.9 THEN CASE WHEN copy_number > 2 THEN 'chromosome_gain' ELSE 'chromosome_loss' END WHEN copy_number > 2 THEN 'duplication' ELSE 'deletion' END AS event_type
  FROM seg s LEFT JOIN fx_contigs c ON s.chrom = c.chrom WHERE bin_count >= 1 AND abs(call) >= 1e-12)"""


@query("cnv_event_typing", f"WITH {sql('sites', 'contigs')}, {_TYPED} SELECT chrom, start_pos, end_pos, copy_number, event_type, round(fraction, 9) AS fraction, fraction >= 0.9 AND start_pos = 0 AND end_pos = length AS span_confirmed FROM ty")
def cnv_event_typing(spark, sf_dir):
    return segments.typed_events(collapsed(spark, sf_dir), fixture(spark, sf_dir, "contigs"), 2.0, 1, 0.9)


@query("iscn_fragments", f"""WITH {sql('calls')}, e AS (SELECT event_id, chrom, start_pos, CASE WHEN event_type = 'inversion' THEN 'chromosome_gain' ELSE event_type END AS kind, copy_number, CASE WHEN support_reads % 9 <> 0 THEN 'q' || start_pos // 500000 END AS b1, 'q' || end_pos // 500000 AS b2, support_reads % 2 = 0 AS ok FROM fx_calls),
f AS (SELECT *, CASE WHEN kind = 'chromosome_gain' AND ok THEN '+' || replace(chrom, 'chr', '') WHEN kind IN ('deletion', 'duplication') AND b1 IS NOT NULL THEN CASE kind WHEN 'deletion' THEN 'del' ELSE 'dup' END || '(' || replace(chrom, 'chr', '') || ')(' || CASE WHEN b1 = b2 THEN b1 ELSE b1 || b2 END || ')' END AS fragment FROM e)
SELECT event_id, fragment, CASE WHEN fragment IS NULL THEN 'OMITTED' WHEN row_number() OVER (PARTITION BY fragment ORDER BY chrom, start_pos, event_id) = 1 THEN 'RENDERED' ELSE 'DUPLICATE' END AS disposition FROM f""")
def iscn_fragments(spark, sf_dir):
    e = fixture(spark, sf_dir, "calls")
    band = lambda c: F.concat(F.lit("q"), F.expr(f"{c} div 500000").cast("string"))
    kind = F.when(F.col("event_type") == "inversion", "chromosome_gain").otherwise(F.col("event_type"))
    fragment = segments.iscn_fragment(kind, F.col("chrom"), F.col("copy_number"), F.when(F.col("support_reads") % 9 != 0, band("start_pos")), band("end_pos"), F.col("support_reads") % 2 == 0)
    rows = e.select("event_id", "chrom", "start_pos", fragment.alias("fragment"))
    return segments.dispositions(rows, ["chrom", "start_pos", "event_id"]).select("event_id", "fragment", "disposition")


_SETS = """ev AS (SELECT event_id, list_sort(list(DISTINCT label)) AS genes FROM (SELECT c.event_id, t.label FROM fx_calls c JOIN fx_targets t ON c.chrom = t.chrom AND c.start_pos < t.end_pos AND t.start_pos < c.end_pos) GROUP BY 1),
rec AS (SELECT 'r' || i AS record_id, CASE WHEN i % 2 = 0 THEN 'exact_pair' ELSE 'gene_any_partner' END AS pattern_type, CASE WHEN i % 2 = 0 THEN ['BRAND#' || (1 + i % 5) || (1 + i // 2 % 5), 'BRAND#' || (1 + i % 4) || (1 + i % 3)] ELSE ['BRAND#' || (1 + i % 5) || (1 + i % 4)] END AS genes FROM range(40) r(i))"""


@query("geneset_match", f"""WITH {sql('calls', 'targets')}, {_SETS}
SELECT event_id, record_id, pattern_type AS rule FROM ev, rec WHERE list_has_all([upper(x) for x in ev.genes], [upper(x) for x in rec.genes]) AND (pattern_type = 'exact_pair' OR len(ev.genes) >= 2)""")
def geneset_match(spark, sf_dir):
    from genostrata.operators.rangejoin import merged_intervals, overlap_join
    from genostrata.plans.intervals import left, right

    calls = fixture(spark, sf_dir, "calls")
    events = overlap_join(left(calls, "event_id"), merged_intervals(right(fixture(spark, sf_dir, "targets"), "label"), ["label"])).groupBy("event_id").agg(F.collect_set("label").alias("genes"))
    i = F.col("id")
    n = lambda c: c.cast("string")
    pair = F.array(F.concat(F.lit("BRAND#"), n(1 + i % 5), n(1 + F.expr("id div 2") % 5)), F.concat(F.lit("BRAND#"), n(1 + i % 4), n(1 + i % 3)))
    one = F.array(F.concat(F.lit("BRAND#"), n(1 + i % 5), n(1 + i % 4)))
    records = spark.range(40).select(F.concat(F.lit("r"), n(i)).alias("record_id"), F.when(i % 2 == 0, "exact_pair").otherwise("gene_any_partner").alias("pattern_type"), F.when(i % 2 == 0, pair).otherwise(one).alias("genes"))
    return annotate.gene_set_matches(events, records)


@query("panel_reachability", f"""WITH {sql('targets')}, cr AS (SELECT 'c' || i AS record_id, i % 4 <> 3 AS needs, CASE WHEN i % 7 = 0 THEN [] ELSE ['Brand#' || (1 + i % 5) || (1 + i % 3), 'Gene' || i % 3] END AS genes FROM range(30) r(i)),
pn AS (SELECT DISTINCT label AS gene FROM fx_targets WHERE target_id % 11 < 6 UNION SELECT 'Gene1'),
p AS (SELECT record_id, needs, genes, coalesce((SELECT list_sort(list(DISTINCT g)) FROM unnest(genes) u(g) WHERE g IN (SELECT gene FROM pn)), []) AS present, coalesce((SELECT list_sort(list(DISTINCT g)) FROM unnest(genes) u(g) WHERE g NOT IN (SELECT gene FROM pn)), []) AS missing FROM cr)
SELECT record_id, CASE WHEN NOT needs THEN 'NOT_PANEL_GATED' WHEN len(genes) = 0 THEN 'NO_GENES_NAMED' WHEN len(missing) = 0 THEN 'REACHABLE' WHEN len(present) = 0 THEN 'UNREACHABLE' ELSE 'PARTIAL' END AS status, array_to_string(present, ',') AS present, array_to_string(missing, ',') AS missing FROM p""")
def panel_reachability(spark, sf_dir):
    i = F.col("id")
    n = lambda c: c.cast("string")
    genes = F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Brand#"), n(1 + i % 5), n(1 + i % 3)), F.concat(F.lit("Gene"), n(i % 3))))
    criteria = spark.range(30).select(F.concat(F.lit("c"), n(i)).alias("record_id"), (i % 4 != 3).alias("needs_small_variants"), genes.alias("genes"))
    panel = fixture(spark, sf_dir, "targets").where("target_id % 11 < 6").select(F.col("label").alias("gene")).union(spark.range(1).select(F.lit("Gene1")))
    return annotate.panel_reach(criteria, panel)


_LANES = "lanes AS (SELECT chrom, caller, CASE WHEN count(*) FILTER (filter = 'PASS') % 5 = 0 THEN 'NO_CALL' WHEN count(*) % 7 = 0 THEN 'FAILED' WHEN count(*) % 11 = 0 THEN 'NOT_RUN' ELSE 'COMPLETED' END AS state FROM fx_calls GROUP BY 1, 2)"


def lanes(spark, sf_dir) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col("filter") == "PASS")
    state = F.when(ok % 5 == 0, "NO_CALL").when(n % 7 == 0, "FAILED").when(n % 11 == 0, "NOT_RUN").otherwise("COMPLETED")
    return fixture(spark, sf_dir, "calls").groupBy("chrom", "caller").agg(state.alias("state"))


@query("run_state_rates", f"""WITH {sql('calls')}, {_LANES}, g AS (SELECT caller, count(*) AS lanes, count(*) FILTER (state <> 'NOT_RUN') AS executed, count(*) FILTER (state = 'NO_CALL') AS no_call, count(*) FILTER (state = 'FAILED') AS failed FROM lanes GROUP BY GROUPING SETS ((caller), ()))
SELECT *, round(no_call / nullif(executed, 0), 9) AS no_call_rate, round(failed / nullif(executed, 0), 9) AS failure_rate FROM g""")
def run_state_rates(spark, sf_dir):
    return audit.rate_table(lanes(spark, sf_dir), ["caller"])


@query("specificity", f"""WITH {sql('calls')}, {_LANES}, fp AS (SELECT chrom, caller, count(*) FILTER (filter <> 'PASS') AS fp, count(*) AS n FROM fx_calls GROUP BY 1, 2)
SELECT caller, bool_and(state <> 'NOT_RUN') AS complete, CASE WHEN bool_and(state <> 'NOT_RUN') THEN round((sum(n) - sum(fp)) / sum(n), 9) END AS specificity FROM lanes JOIN fp USING (chrom, caller) GROUP BY caller""")
def specificity(spark, sf_dir):
    fp = fixture(spark, sf_dir, "calls").groupBy("chrom", "caller").agg(F.count_if(F.col("filter") != "PASS").alias("fp"), F.count(F.lit(1)).alias("n"))
    return metrics.specificity(lanes(spark, sf_dir).join(fp, ["chrom", "caller"]), "caller")


@query("reproducibility_pairs", f"""WITH {sql('calls')}, r AS (SELECT DISTINCT event_type AS grp, support_reads % 4 AS repeat, chrom || ':' || start_pos // 100000 AS item FROM fx_calls),
s AS (SELECT grp, repeat, count(*) AS n FROM r GROUP BY 1, 2), x AS (SELECT a.grp, a.repeat AS l, b.repeat AS k, count(*) AS c FROM r a JOIN r b ON a.grp = b.grp AND a.item = b.item AND a.repeat < b.repeat GROUP BY 1, 2, 3)
SELECT a.grp, a.repeat AS left_id, b.repeat AS right_id, round(2 * coalesce(c, 0) / nullif(a.n + b.n, 0), 9) AS score FROM s a JOIN s b ON a.grp = b.grp AND a.repeat < b.repeat LEFT JOIN x ON x.grp = a.grp AND x.l = a.repeat AND x.k = b.repeat""")
def reproducibility_pairs(spark, sf_dir):
    rows = fixture(spark, sf_dir, "calls").select(F.col("event_type").alias("grp"), (F.col("support_reads") % 4).alias("repeat"), F.concat_ws(":", "chrom", F.expr("start_pos div 100000").cast("string")).alias("item"))
    return audit.repeat_pairs(rows)


@query("cn_error", f"""WITH {sql('calls')} SELECT event_type, count(*) AS n, round(avg(abs(copy_number - 2)), 9) AS mae, round(avg(copy_number - 2), 9) AS bias FROM fx_calls GROUP BY 1""")
def cn_error(spark, sf_dir):
    return metrics.quantitative_error(fixture(spark, sf_dir, "calls"), "event_type", F.col("copy_number"), F.lit(2))


@query("acceptance_decisions", f"""WITH {sql('calls')}, m AS (SELECT chrom, avg(vaf) AS value, count(*) FILTER (filter <> 'PASS') * 1.0 / count(*) AS no_call_rate FROM fx_calls WHERE chrom <> 'chr3' GROUP BY 1),
q AS (SELECT 'chr' || i AS chrom, i % 6 <> 0 AS applies, 0.049 + (i % 3) * 0.001 AS floor_ FROM range(1, 25) r(i))
SELECT q.chrom, CASE WHEN NOT applies THEN 'NOT_APPLICABLE' WHEN no_call_rate = 1.0 THEN 'NO_CALL' WHEN value IS NULL THEN 'NOT_EVALUABLE' WHEN value >= floor_ THEN 'PASS' ELSE 'FAIL' END AS verdict FROM q LEFT JOIN m USING (chrom)""")
def acceptance_decisions(spark, sf_dir):
    m = fixture(spark, sf_dir, "calls").where("chrom <> 'chr3'").groupBy("chrom").agg(F.avg("vaf").alias("value"), (F.count_if(F.col("filter") != "PASS") / F.count(F.lit(1))).alias("no_call_rate"))
    q = spark.range(1, 25).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), (F.col("id") % 6 != 0).alias("applies"), (F.lit(0.049) + (F.col("id") % 3) * 0.001).alias("floor"))
    return audit.decisions(q, m, "chrom")


@query("lineage_orphans", f"""WITH {sql('calls', 'targets')} SELECT event_id, start_pos % 2200 AS target_id FROM fx_calls WHERE start_pos % 2200 NOT IN (SELECT target_id FROM fx_targets)""")
def lineage_orphans(spark, sf_dir):
    evidence = fixture(spark, sf_dir, "calls").select("event_id", (F.col("start_pos") % 2200).alias("target_id"))
    return audit.orphans(evidence, fixture(spark, sf_dir, "targets"), "target_id").select("event_id", "target_id")


@query("hash_chain_verify", """WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
d AS (SELECT *, sha256(user_id || '|' || seq || '|' || event_id || '|' || event_type) AS digest FROM c), p AS (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM d),
t AS (SELECT user_id, seq, CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE digest END AS digest, digest AS should, CASE WHEN event_id % 89 = 0 THEN 'x' ELSE prev END AS prev FROM p WHERE event_id % 101 <> 0)
SELECT user_id, seq, fault FROM (SELECT user_id, seq, CASE WHEN seq <> coalesce(lag(seq) OVER w, 0) + 1 THEN 'sequence_gap' WHEN prev IS DISTINCT FROM lag(digest) OVER w THEN 'broken_link' WHEN digest <> should THEN 'wrong_digest' END AS fault FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE fault IS NOT NULL""")
def hash_chain_verify(spark, sf_dir):
    log = audit.chain(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_id", "event_type"])
    # Tampering that follows from the ids: a wrong digest, a wrong link, a missing entry.
    log = log.withColumn("digest", F.when(F.col("event_id") % 97 == 0, "bad").otherwise(F.col("digest"))).withColumn("prev", F.when(F.col("event_id") % 89 == 0, "x").otherwise(F.col("prev"))).where("event_id % 101 <> 0")
    return audit.chain_breaks(log, "user_id", ["event_id", "event_type"])


@query("ledger_state", """WITH a AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'LOCKED' ELSE 'REJECTED' END AS state FROM events),
l AS (SELECT user_id, max_by(state, event_id) AS state, count(*) AS attempts, max(event_id) AS last_at FROM a GROUP BY 1)
SELECT *, CASE state WHEN 'LOCKED' THEN 'always' WHEN 'FAILED' THEN 'on_request' ELSE 'never' END AS retry FROM l""")
def ledger_state(spark, sf_dir):
    k = F.col("event_id") % 4
    a = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(k == 0, "COMPLETED").when(k == 1, "FAILED").when(k == 2, "LOCKED").otherwise("REJECTED").alias("state"))
    return audit.ledger(a, "user_id", "event_id")


_EDGES = """edges AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < 24),
nodes AS (SELECT node, CASE WHEN node IN ('n3', 'r4') THEN 'FAILED' WHEN node = 'n7' THEN 'NO_CALL' ELSE 'COMPLETED' END AS outcome FROM (SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation))"""


def graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")) if isinstance(c, str) else F.concat(F.lit(p), c.cast("string"))
    edges = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(name("r", "r_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    edges = edges.union(n.where("n_nationkey % 3 = 0 AND n_nationkey < 24").select(name("n", "n_nationkey"), name("n", F.col("n_nationkey") + 1)))
    nodes = r.select(name("r", "r_regionkey").alias("node")).union(n.select(name("n", "n_nationkey")))
    outcome = F.when(F.col("node").isin("n3", "r4"), "FAILED").when(F.col("node") == "n7", "NO_CALL").otherwise("COMPLETED")
    return edges, nodes.withColumn("outcome", outcome)


@query("dag_levels", f"WITH RECURSIVE {_EDGES}, walk(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.node) SELECT node, CAST(max(level) AS INT) AS level FROM walk GROUP BY node")
def dag_levels(spark, sf_dir):
    return audit.levels(*graph(spark, sf_dir))


@query("dag_blocked", f"WITH RECURSIVE {_EDGES}, down(node) AS (SELECT e.child FROM edges e JOIN nodes n ON n.node = e.parent WHERE n.outcome NOT IN ('COMPLETED', 'NO_CALL') UNION ALL SELECT e.child FROM down d JOIN edges e ON e.parent = d.node) SELECT node, CASE WHEN node IN (SELECT node FROM down) THEN 'NOT_RUN' ELSE outcome END AS state FROM nodes")
def dag_blocked(spark, sf_dir):
    return audit.blocked(*graph(spark, sf_dir))


_A, _B = "SELECT chrom, event_type, support_reads FROM fx_calls WHERE caller = 'caller_a'", "SELECT chrom, event_type, support_reads FROM fx_calls WHERE caller = 'caller_b'"


@query("set_ops", f"""WITH {sql('calls')}, a AS ({_A}), b AS ({_B})
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'except_all', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def set_ops(spark, sf_dir):
    calls = fixture(spark, sf_dir, "calls")
    a, b = (calls.where(f"caller = '{c}'").select("chrom", "event_type", "support_reads") for c in ("caller_a", "caller_b"))
    ops = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "intersect_all": a.intersectAll(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    out = None
    for name, rows in ops.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query("violations_events", f"""WITH {sql('calls')} SELECT event_id, 'end_not_after_start' AS rule FROM fx_calls WHERE end_pos <= start_pos UNION ALL SELECT event_id, 'vaf_out_of_range' FROM fx_calls WHERE vaf < 0 OR vaf > 1 UNION ALL SELECT event_id, 'unknown_type' FROM fx_calls WHERE event_type NOT IN ('deletion', 'duplication', 'inversion', 'insertion')""")
def violations_events(spark, sf_dir):
    from genostrata.operators.contracts import violations

    return violations(fixture(spark, sf_dir, "calls"), "event_id", [("end_not_after_start", "end_pos > start_pos"), ("vaf_out_of_range", "vaf BETWEEN 0 AND 1"), ("unknown_type", "event_type IN ('deletion', 'duplication', 'inversion', 'insertion')")])


@query("violations_thresholds", f"""WITH {sql('targets')}, x AS (SELECT target_id, threshold, CASE WHEN mean_depth >= threshold THEN end_pos - start_pos ELSE 0 END + CASE WHEN target_id % 500 = 0 AND threshold = 20 THEN 100000 ELSE 0 END AS bases FROM fx_targets, (VALUES (1), (10), (20), (30)) v(threshold))
SELECT target_id, CAST(threshold AS INT) AS threshold FROM (SELECT *, lag(bases) OVER (PARTITION BY target_id ORDER BY threshold) AS before FROM x) WHERE bases > before""")
def violations_thresholds(spark, sf_dir):
    from genostrata.operators.contracts import not_decreasing

    t = fixture(spark, sf_dir, "targets").withColumn("threshold", F.explode(F.array(*map(F.lit, (1, 10, 20, 30)))))
    planted = F.when((F.col("target_id") % 500 == 0) & (F.col("threshold") == 20), 100000).otherwise(0)
    bases = F.when(F.col("mean_depth") >= F.col("threshold"), F.col("end_pos") - F.col("start_pos")).otherwise(0) + planted
    return not_decreasing(t.select("target_id", "threshold", bases.alias("bases")), "target_id", "threshold", "bases")


@query("reject_precedence", f"""WITH {sql('reads')} SELECT event_id, CASE WHEN num_motifs > 2 THEN 'too_many_motifs' WHEN abs(llr) < 2.5 * num_motifs THEN 'ambiguous' WHEN marker_id % 13 = 0 THEN 'masked' END AS reason FROM fx_reads""")
def reject_precedence(spark, sf_dir):
    r = fixture(spark, sf_dir, "reads")
    return r.select("event_id", first_reason([("too_many_motifs", F.col("num_motifs") > 2), ("ambiguous", F.abs("llr") < 2.5 * F.col("num_motifs")), ("masked", F.col("marker_id") % 13 == 0)]).alias("reason"))


@query("monotone_ladder", f"""WITH {sql('targets')} SELECT target_id, bool_and(mean_depth >= 20) OVER (PARTITION BY chrom ORDER BY mean_depth DESC, target_id ROWS UNBOUNDED PRECEDING) AS all_above FROM fx_targets""")
def monotone_ladder(spark, sf_dir):
    w = Window.partitionBy("chrom").orderBy(F.desc("mean_depth"), "target_id").rowsBetween(Window.unboundedPreceding, 0)
    return fixture(spark, sf_dir, "targets").select("target_id", F.bool_and(F.col("mean_depth") >= 20).over(w).alias("all_above"))
