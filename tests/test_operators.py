"""Operators on small literal tables, against brute force where order or search matters."""

import random

import pytest
from pyspark.sql import functions as F

from genostrata.functions import coords, stats, text
from genostrata.operators import annotate, audit, benchmark, consensus, contracts, coverage
from genostrata.operators.components import components
from genostrata.operators.rangejoin import nearest, overlap_join
from genostrata.sources import tables, vcf


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("name", "want"), [("1", "chr1"), ("CHRx", "chrX"), ("chrM", "chrM"), ("MT", "chrM"), ("GL0001", "GL0001"), ("", None)])
def test_normalize_contig(spark, name, want):
    assert one(spark, coords.normalize_contig(F.lit(name))) == want


def test_coordinates(spark):
    v = one(spark, coords.from_format(F.lit(1), F.lit(10), "gtf"))
    assert (v["start"], v["end"], v["conversion"], v["error"]) == (0, 10, "start_minus_one", None)
    assert one(spark, coords.from_format(F.lit(5), F.lit(None).cast("int"), "vcf"))["end"] == 5
    assert one(spark, coords.from_format(F.lit(5), F.lit(5), "bed"))["error"] == "empty_interval"
    assert one(spark, coords.normalize_orientation(F.lit("+/ -"))) == "+-"
    assert one(spark, coords.orientation_set(F.array(F.lit("+-"), F.lit(None)), F.lit(True))) == ["-+"]


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(3)
    mk = lambda n, long: [(i, f"chr{rng.randint(1, 2)}", s := rng.randint(0, 3_000_000), s + rng.choice([1, 50, 20_000, long])) for i in range(n)]
    a, b = mk(300, 900_000), mk(200, 2_500_000)
    left = spark.createDataFrame(a, "l_id long, l_chrom string, l_start long, l_end long")
    right = spark.createDataFrame(b, "r_id long, r_chrom string, r_start long, r_end long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r["l_id"], r["r_id"]) for r in overlap_join(left, right).collect()) == want
    hit = {x for x, _ in want}
    assert {r["l_id"] for r in overlap_join(left, right, how="left_semi").collect()} == hit
    assert {r["l_id"] for r in overlap_join(left, right, how="left_anti").collect()} == {x[0] for x in a} - hit


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, f"chr{rng.randint(1, 3)}", s := rng.randint(0, 5_000_000), s + 1) for i in range(200)]
    ivs = [("chr%d" % rng.randint(1, 2), s := rng.randint(0, 5_000_000), s + rng.choice([10, 5000]), f"g{i}") for i in range(40)]
    got = {r["l_id"]: (r["distance"], r["r_label"]) for r in nearest(spark.createDataFrame(pts, "l_id long, l_chrom string, l_start long, l_end long"), spark.createDataFrame(ivs, "r_chrom string, r_start long, r_end long, r_label string")).collect()}
    want = {}
    for i, c, s, e in pts:
        d = sorted((0 if s < y and x < e else min(abs(s - y), abs(x - e)), x, y, g) for k, x, y, g in ivs if k == c)
        if d:
            want[i] = (d[0][0], d[0][3])
    assert got == want


def test_matching_has_the_largest_size(spark):
    rng = random.Random(1)
    edges = sorted({(f"t{rng.randint(0, 25)}", f"q{rng.randint(0, 20)}") for _ in range(60)})
    got = benchmark.best_matching(spark.createDataFrame([(t, q, rng.random()) for t, q in edges], "truth_id string, query_id string, score double")).collect()
    assert len({r["truth_id"] for r in got}) == len({r["query_id"] for r in got}) == len(got)
    assert all((r["truth_id"], r["query_id"]) in edges for r in got)
    owner = {}

    def augment(t, seen):
        for a, q in edges:
            if a == t and q not in seen:
                seen.add(q)
                if q not in owner or augment(owner[q], seen):
                    owner[q] = t
                    return True
        return False

    assert len(got) == sum(augment(t, set()) for t in sorted({t for t, _ in edges}))


def test_components(spark):
    rows = [(i, i + 1) for i in range(30) if i % 10 != 9] + [(40, 41), (41, 40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got[9] == 0 and got[19] == 10 and got[41] == 40


def test_consensus_clusters_follow_the_head(spark):
    calls = [("a", "chr1", "deletion", 100, 1100, "x", 9), ("b", "chr1", "deletion", 400, 1400, "y", 5), ("c", "chr1", "deletion", 850, 1850, "x", 4), ("d", "chr2", "deletion", 100, 1100, "x", 3)]
    df = spark.createDataFrame(calls, "event_id string, chrom string, event_type string, start_pos long, end_pos long, caller string, support_reads int")
    got = {r["event_id"]: r["head"] for r in consensus.cluster_calls(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}  # c is near b but not near the head
    top = {r["head"]: r for r in consensus.merged(df, consensus.cluster_calls(df)).collect()}
    assert top["a"]["callers"] == "x,y" and top["a"]["status"] == "technically_supported" and top["a"]["representative"] == "a"


def test_detection_limit(spark):
    rows = [(f, d) for f, hits in ((0.5, 3), (0.2, 3), (0.1, 1), (0.05, 3)) for d in [1] * hits + [0] * (3 - hits)] + [(0.5, None)]
    got = benchmark.limit_of_detection(spark.createDataFrame(rows, "fraction double, detected int"), 0.95, 3).collect()
    assert {r["limit"] for r in got} == {0.2} and all(r["bracketed"] for r in got)
    none = benchmark.limit_of_detection(spark.createDataFrame([(0.5, 0)], "fraction double, detected int"), 0.95, 1).first()
    assert none["limit"] is None and none["bracketed"] is False


def test_min_reads_table(spark):
    depths = [9, 20, 30, 50, 100, 500]
    got = dict(stats.min_variant_reads(spark.createDataFrame([(d,) for d in depths], "depth int"), 0.01, 0.01).collect())
    assert got[9] == 2 and got[500] == 12 and all(got[a] <= got[b] for a, b in zip(depths, depths[1:]))


def test_undefined_stays_null(spark):
    assert one(spark, benchmark.rates(F.lit(0), F.lit(0), F.lit(0))[0]) is None
    assert one(spark, stats.copy_number_from_ratio(F.lit(0.1), F.lit(0.5))) is None
    v = one(spark, stats.doubled_fraction(F.lit(0), F.lit(50), F.lit(True), F.lit(2.0)))
    assert v["status"] == "no_variant_reads" and v["point"] is None


def test_breakends_and_info(spark):
    v = one(spark, vcf.breakend(F.lit("N]chr5:7654321]")))
    assert (v["mate_chrom"], v["mate_pos"], v["form"], v["error"]) == ("chr5", 7654320, "t]p]", None)
    assert one(spark, vcf.breakend(F.lit("[chr1:5[A")))["form"] == "[p[t"
    assert one(spark, vcf.breakend(F.lit("N]chr2:5[")))["error"] == "malformed_breakend_alt"
    assert one(spark, vcf.info_map(F.lit("A=1;FLAG;B=x=y;A=2"))) == {"A": "2", "FLAG": None, "B": "x=y"}
    assert one(spark, vcf.number(F.lit("."))) is None and one(spark, vcf.number(F.lit("3,4"))) == 3.0


def test_structural_variant_reasons(spark):
    rows = ["##x", "chr11\t2468013\tmate_a\tG\tN]chr5:7654321]\t44\tPASS\tSVTYPE=BND;RE=12;PRECISE\tGT:DR:DV\t0/1:28:12", "chr1\t0\tc2\tN\t<DEL>\t60\tPASS\tSVTYPE=DEL;END=900\tGT\t0/1", "chr1\t100\tc3\tN\t<DEL>\t60\tPASS\t=1\tGT\t0/1"]
    got = {r["record_id"]: r for r in vcf.structural_variants(spark.createDataFrame([(x,) for x in rows], "value string")).collect()}
    assert got["mate_a"]["reason"] is None and got["mate_a"]["vaf"] == 0.3 and got["mate_a"]["length"] is None and got["mate_a"]["precise"]
    assert got["c2"]["reason"] == "malformed_position" and got["c3"]["reason"] == "malformed_info"


def test_allele_rows(spark):
    line = "chr1\t10\t.\tA\tG,AT\t.\tPASS\t.\tGT:AD:DP\t0/1:10,5,5:20"
    got = vcf.allele_rows(spark.createDataFrame([(line,)], "value string")).collect()
    assert [(r["alt"], r["fraction"], r["class"]) for r in got] == [("G", 0.25, "SNV"), ("AT", 0.25, "INS")]


def test_files_fail_whole(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert tables.target_bed(lines("1\t5\t9", "chrX\t1\t2\tG")).count() == 2
    with pytest.raises(Exception, match="malformed target line"):
        tables.target_bed(lines("chr1\t9\t5")).collect()
    with pytest.raises(Exception, match="sum of its parts"):
        tables.bedmethyl(lines("chr1\t1\t2\tm\t1\t+\t1\t2\t0\t10\t0\t3\t3\t3\t0\t0\t0\t0")).collect()


def test_annotation_files(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    attrs = 'gene_id "g1"; transcript_id "t1"; gene_name "BCR"; transcript_type "protein_coding"; tag "basic"; tag "appris_principal_1";'
    g = tables.gtf(lines(*(f"chr22\tX\t{k}\t{s}\t{e}\t.\t+\t.\t{attrs}" for k, s, e in (("transcript", 101, 400), ("exon", 101, 200), ("CDS", 151, 200)))))
    t = tables.gtf_transcripts(g).first()
    assert (t["cds_length"], t["transcript_length"], t["is_basic"], t["appris"], t["start_pos"]) == (50, 100, True, "appris_principal_1", 100)
    assert one(spark, tables.gff3_attributes(F.lit("ID=a%20b;x=1+2"))) == {"ID": "a b", "x": "1+2"}
    assert tables.sam_header(lines("@SQ\tSN:chr1\tLN:5")).first()["fields"] == {"SN": "chr1", "LN": "5"}
    doc = '{"alignment_stats":{"mean":2.5},"read_stats":{"n50":9},"histograms":{"read_length":{"bins":[{"start":0,"end":10,"count":1,"bases":5},{"start":10,"count":2,"bases":40}]}}}'
    assert dict(tables.qc_metrics(lines(doc)).collect()) == {"mean": 2.5, "n50": 9.0}
    assert [r["end"] for r in tables.qc_histogram(lines(doc)).collect()] == [10, None]
    assert tables.cytobands(lines("chr9\t0\t5\tp1\tg", "chr9\t0\t5\tp1\tg", "chr9\t5\t6\t\tg")).count() == 1


def test_text_helpers(spark):
    assert one(spark, text.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert one(spark, text.version_of(F.lit("tool v2.6.1 build"))) == "2.6.1"
    assert one(spark, text.safe_cell(F.lit("=1+1"))) == "'=1+1"


def test_contracts(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 3.0)], "k string, v double, w double")
    b = spark.createDataFrame([("x", 1.0, 0.0), ("y", 2.5, 3.0)], "k string, v double, w double")
    assert sorted(tuple(r) for r in contracts.recomputed(a, b, "k").collect()) == [("x", "w"), ("y", "v")]
    assert contracts.violations(a, "k", [("w_known", "w > 0")]).collect()[0]["k"] == "x"
    assert contracts.duplicates(a.union(a), ["k"]).count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "chrom string, start_pos long, end_pos long, mean_depth double, target_id long")
    assert coverage.summary(empty, (10,)).count() == 0 and coverage.overlapping(empty).count() == 0
    assert audit.orphans(empty, empty, "target_id").count() == 0
    pairs = spark.createDataFrame([], "truth_id string, query_id string, score double")
    assert benchmark.best_matching(pairs).count() == 0
    assert annotate.gene_set_matches(spark.createDataFrame([], "event_id string, genes array<string>"), spark.createDataFrame([("r", "exact_pair", ["A"])], "record_id string, pattern_type string, genes array<string>")).count() == 0


def test_sinks(spark, tmp_path):
    import csv
    import glob

    from genostrata.sources import sinks

    df = spark.createDataFrame([("=1", [1, 2], 3), ("a", None, 4)], "t string, l array<int>, n int")
    sinks.write_view(df.coalesce(1), str(tmp_path / "v"))
    rows = list(csv.reader(open(glob.glob(str(tmp_path / "v/*.csv"))[0])))
    assert rows[0] == ["t", "l", "n"] and rows[1] == ["'=1", "[1,2]", "3"]
    sinks.write_documents(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2
    assert len(sinks.manifest(spark, str(tmp_path / "d")).where("name LIKE '%.json'").first()["sha256"]) == 64
    assert sinks.fingerprint(df).first() == sinks.fingerprint(df.repartition(3)).first()
    assert "array" in sinks.schemas({"x": df})["x"]
    sinks.write_annotation(spark.createDataFrame([("chr1", 5), ("chr2", 1)], "chrom string, start_pos long"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).where("chrom = 'chr2'").count() == 1


def test_seal_tells_null_from_text(spark):
    from genostrata.operators import planning

    df = spark.createDataFrame([(1, None, "a"), (1, "null", "a"), (1, "", "a")], "n int, s string, t string")
    assert df.select(planning.sealed(df, ["s", "n", "t"]).alias("x")).distinct().count() == 3
