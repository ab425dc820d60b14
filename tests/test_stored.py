"""Published annotation, stored intervals and range joins of long intervals."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from genostrata.operators import rangejoin, stored_intervals
from genostrata.sources import annotation, published, tables


def gene_line(feature, start, end, attributes, chrom="chr9", strand="+", phase="."):
    return "\t".join([chrom, "src", feature, str(start), str(end), ".", strand, phase, attributes])


G1 = 'gene_id "G1.5"; gene_name "ONE"; gene_type "coding";'
GENES = [
    "##comment", gene_line("gene", 101, 900, G1), gene_line("transcript", 101, 900, G1 + ' transcript_id "T1.2"; tag "basic"; tag "appris_principal_1"; tag "Ensembl_canonical";'), gene_line("exon", 101, 300, G1 + ' transcript_id "T1.2"; exon_number 1; exon_id "E1";'), gene_line("exon", 701, 900, G1 + ' transcript_id "T1.2"; exon_number 2;'),
    gene_line("exon", 701, 900, G1 + ' transcript_id "T1.2"; exon_number 2;'), gene_line("CDS", 201, 300, G1 + ' transcript_id "T1.2";', phase="0"), gene_line("transcript", 301, 500, G1 + ' transcript_id "T2.1";'), gene_line("start_codon", 201, 203, G1), gene_line("gene", 1, 50, 'gene_id "G2";', chrom="scaffold_7"),
    gene_line("gene", 1001, 1500, 'gene_id "G3.1"; gene_biotype=coding;', chrom="22", strand="-"), gene_line("transcript", 1001, 1500, 'gene_id "G3.1"; transcript_id "T3.7"; tag "gencode_primary"', chrom="22", strand="-"),
]
CURATED = ["##gff", gene_line("mRNA", 101, 900, "ID=transcript:T1.2;tag=x,MANE%20Plus%20Clinical;Dbxref=RefSeq:NM_1.3"), gene_line("mRNA", 101, 900, "ID=transcript:T1.2;tag=MANE%20Select;Dbxref=RefSeq:NM_1.4"), gene_line("transcript", 1001, 1500, "transcript_id=T3.9;tag=MANE Plus Clinical;Name=NM_33.1", chrom="chr22", strand="-"), gene_line("mRNA", 5, 9, "ID=transcript:T9;tag=other"), gene_line("exon", 5, 9, "broken")]
BANDS = ["chr9\t0\t5000\tq34.1\tgneg", "chr9\t0\t5000\tq34.1\tgneg", "chr9\t5000\t6000\t\tgneg"]


def text(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def built(spark, folder, genes=GENES, curated=CURATED, bands=BANDS, build="GRCh38"):
    return annotation.compile_annotation(text(spark, genes), None if curated is None else text(spark, curated), text(spark, bands), str(folder), build=build, release="r1")


def test_build_from_compressed_files(spark, tmp_path):
    for name, rows in (("g.gtf.gz", GENES), ("m.gff3.gz", CURATED), ("b.tsv.gz", BANDS)):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(rows) + "\n")
    read = lambda name: annotation.lines(spark, str(tmp_path / name))
    version = annotation.compile_annotation(read("g.gtf.gz"), read("m.gff3.gz"), read("b.tsv.gz"), str(tmp_path / "out"), build="GRCh38", release="r1")
    facts = published.facts_of(spark, annotation.open_annotation(spark, version, build="GRCh38"))
    assert facts["counts"] == {"genes": 2, "transcripts": 3, "exons": 2, "cds": 1, "cytobands": 1}
    t = {r["transcript_id"]: r for r in annotation.opened(spark, version, "transcripts").collect()}
    one, two, three = t["T1.2"], t["T2.1"], t["T3.7"]
    assert (one["mane_status"], one["mane_refseq_id"], one["transcript_length"], one["cds_length"], one["appris"], one["is_basic"], one["is_canonical"]) == ("MANE Select", "NM_1.4", 400, 100, "appris_principal_1", True, True)
    assert "MANE_Select" in one["tags"] and (two["mane_status"], two["transcript_length"], two["cds_length"], two["is_basic"]) == (None, 200, 0, False)
    assert (three["mane_status"], three["mane_refseq_id"], three["chrom"], three["start_pos"], three["is_canonical"]) == ("MANE Plus Clinical", "NM_33.1", "chr22", 1000, True)
    genes = {r["gene_id"]: (r["gene_name"], r["gene_type"]) for r in annotation.opened(spark, version, "genes").collect()}
    assert genes == {"G1.5": ("ONE", "coding"), "G3.1": ("G3.1", "coding")}


def test_lookup_reads_the_contigs_of_the_points(spark, tmp_path):
    version = built(spark, tmp_path)
    points = spark.createDataFrame([(1, "chr9", 350), (2, "chr9", 950), (3, None, 5)], "id long, l_chrom string, l_pos long")
    hits = annotation.at_points(points, version)
    assert {(r["id"], r["transcript_id"]) for r in hits.collect()} == {(1, "T1.2"), (1, "T2.1")}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "chr9" in plan and "chr22" not in plan


@pytest.mark.parametrize(("change", "says"), [
    (dict(build="GRCh37"), "GRCh37 has none"), (dict(curated=None), "needs the curated"), (dict(build="hg19"), "none of"), (dict(curated=[CURATED[1].replace("\t101\t", "\t102\t")]), "another locus"), (dict(genes=[*GENES, gene_line("exon", 1, 9, 'gene_id "G1.5"; transcript_id "T8";')]), "absent transcripts: T8"),
    (dict(genes=[*GENES, gene_line("transcript", 1, 9, 'gene_id "G8"; transcript_id "T8";')]), "absent genes: G8"), (dict(bands=["chr9\t0\t5\t\tgneg"]), "without"), (dict(curated=[gene_line("mRNA", 1, 9, "ID=transcript:T77;tag=MANE Select")]), "no transcript of the curated set"), (dict(genes=[*GENES, "chr1\tx\tgene\t5"]), "nine columns"),
    (dict(genes=[*GENES, gene_line("gene", 9, 5, 'gene_id "G9";')]), "span"), (dict(genes=[*GENES, gene_line("gene", 5, 9, 'gene_id "G9";', strand=".")]), "strand"), (dict(genes=[*GENES, gene_line("gene", 5, 9, "gene_name x")]), "gene_id"), (dict(genes=[*GENES, gene_line("CDS", 5, 9, 'gene_id "G9"; transcript_id "T1.2"', phase="3")]), "phase"),
    (dict(genes=[*GENES, gene_line("exon", 5, 9, 'gene_id "G9"; transcript_id "T1.2"; exon_number x')]), "number"), (dict(genes=[g.replace('tag "basic"', 'tag "MANE_Select"') for g in GENES], curated=None, build="GRCh37"), "claims"),
])
def test_what_does_not_hold_is_not_published(spark, tmp_path, change, says):
    with pytest.raises(Exception, match=says):
        built(spark, tmp_path / "out", **change)
    assert not list((tmp_path / "out").glob("version-*")) if (tmp_path / "out").exists() else True


def test_native_build_and_versions(spark, tmp_path):
    version = built(spark, tmp_path, curated=None, build="GRCh37")
    assert annotation.opened(spark, version, "transcripts").where("mane_status IS NOT NULL").isEmpty()
    with pytest.raises(ValueError, match="of build GRCh37"):
        annotation.open_annotation(spark, version, build="GRCh38")
    with pytest.raises(FileNotFoundError, match="no published version"):
        annotation.open_annotation(spark, str(tmp_path / "nowhere"), build="GRCh37")
    spark.createDataFrame([("x",)], "gene_id string").withColumn("chrom", F.lit("chr1")).write.mode("append").partitionBy("chrom").parquet(f"{version}/genes")
    with pytest.raises(ValueError, match="has 3 rows, its manifest says 2"):
        annotation.open_annotation(spark, version, build="GRCh37")


def spans(n, seed):
    rng = random.Random(seed)
    return [(f"chr{rng.randint(1, 3)}", s := rng.randint(0, 5_000_000), s + rng.choice([1, 50, 3000, 40_000, 2_000_000]), f"i{k}") for k in range(n)]


def test_stored_lookup_equals_the_join_and_reads_few_files(spark, tmp_path):
    rows = spans(3000, 1)
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, label string")
    version = stored_intervals.open_intervals(spark, stored_intervals.store_intervals(df, str(tmp_path), piece_rows=50))
    rng = random.Random(2)
    points = [(k, f"chr{rng.randint(1, 3)}", rng.randint(0, 5_200_000)) for k in range(40)]
    p = spark.createDataFrame(points, "id long, l_chrom string, l_pos long")
    got = {(r["id"], r["label"]) for r in stored_intervals.stored_point_join(p, version).collect()}
    assert got == {(k, x) for k, c, at in points for chrom, s, e, x in rows if c == chrom and s <= at < e}
    files = lambda q: stored_intervals.touched_intervals(q, version).select(F.input_file_name()).distinct().count()
    one = p.where("id = 0")
    all_files = published.opened(spark, version, "intervals").select(F.input_file_name()).distinct().count()
    assert files(one) <= 12 < 60 <= all_files and files(one) <= files(p)
    assert "PartitionFilters: [piece" in stored_intervals.touched_intervals(one, version)._jdf.queryExecution().executedPlan().toString()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(stored_intervals, "MOST_LISTED", 2)
        assert {(r["id"], r["label"]) for r in stored_intervals.stored_point_join(p, version).collect()} == got
    assert stored_intervals.stored_point_join(p.limit(0), version).count() == 0


def test_a_changed_source_is_refused(spark, tmp_path):
    (tmp_path / "c.bed").write_text("track x\n1\t5\t9\tone\n2\t7\t8\n")
    rows = tables.context_bed(spark.read.text(str(tmp_path / "c.bed")), "context")
    assert [tuple(r) for r in rows.orderBy("chrom").collect()] == [("chr1", 5, 9, "one"), ("chr2", 7, 8, "context")]
    version = stored_intervals.store_intervals(rows, str(tmp_path / "out"), source=str(tmp_path / "c.bed"))
    assert stored_intervals.open_intervals(spark, version) == version
    (tmp_path / "c.bed").write_text("1\t5\t9\tone\n1\t5\t9\ttwo\n")
    with pytest.raises(ValueError, match="has changed"):
        stored_intervals.open_intervals(spark, version)
    with pytest.raises(Exception, match="malformed context"):
        tables.context_bed(text(spark, ["1\t9\t9\tx"]), "context").collect()


def test_joins_of_long_and_short_intervals(spark):
    left, right = spans(300, 3), spans(300, 4)
    left.append(("chr1", 0, 250_000_000, "whole"))
    right += [("chr1", 100, 200_000_000, "long"), ("chr2", 5, 5, "empty"), ("chr2", None, 7, "null")]
    l = spark.createDataFrame(left, "l_chrom string, l_start long, l_end long, l_id string")  # noqa: E741
    r = spark.createDataFrame(right, "r_chrom string, r_start long, r_end long, r_id string")
    got = [(x["l_id"], x["r_id"]) for x in rangejoin.overlap_join(l, r).collect()]
    want = [(a[3], b[3]) for a in left for b in right if b[1] is not None and b[1] < b[2] and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]]
    assert sorted(got) == sorted(want)
    one = l.where("l_id = 'whole'").withColumn("__own", rangejoin.interval_level(F.col("l_end") - F.col("l_start")))
    assert rangejoin._posted(one, "l", F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), rangejoin.BIN).count() <= rangejoin.FACTOR + 1
