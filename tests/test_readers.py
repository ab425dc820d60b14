"""Files that must be whole or not at all, and record reasons of variant files."""

import pytest
from pyspark.sql import functions as F

from genostrata.sources import tables, vcf


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_depth_segments(spark):
    rows = ["chr1\t0\ta\tN\t<DEL>\t9\tPASS\tSVTYPE=DEL;END=200000;SVLEN=200000;CN=1\tGT\t0/1", "chr1\t5\tb\tN\t<DUP>\t9\tPASS\tSVTYPE=DUP;END=200000;SVLEN=200000\tGT\t0/1", "chr1\t-1\tc\tN\t.\t9\tPASS\tSVTYPE=DUP;END=9\tGT\t0/1", "chr1\t1\td\tN\t<DUP>\t9\tLOW\tSVTYPE=DUP\tGT\t0/1", "chr1\t1\te\tN\t<DUP>\t9\tPASS\tSVTYPE=DEL;END=5;SVLEN=4\tGT\t0/1", "chr1\t1\tf\tN"]
    got = {r["record_id"]: r for r in vcf.depth_segments(lines(spark, *rows)).collect()}
    assert got["a"]["reason"] is None and (got["a"]["start_pos"], got["a"]["end_pos"], got["a"]["copy_number"]) == (0, 200000, 1.0)
    assert [got[k]["reason"] for k in "bcdef"] == ["native_length_mismatch", "malformed_start", "filter_not_pass", "svtype_alt_mismatch", "malformed_record"]


def test_paired_somatic_records(spark):
    rows = ["chr1\t11\ta\tN\t<DEL>\t60\tLOW\tSVTYPE=DEL:X;END=900;CLASS=SOMATIC;SUPPORT=9", "chr1\t11\tb\tN\t<DEL>\t60\t.\tSVTYPE=DEL;END=900;CLASS=GERMLINE;SUPPORT=9", "chr1\t11\tc\tN\t<DEL>\t60\t.\tSVTYPE=DEL;END=900;SUPPORT=1"]
    got = {r["record_id"]: r["reason"] for r in vcf.structural_variants(lines(spark, *rows), min_support=3, pass_only=False, only_class="SOMATIC").collect()}
    assert got == {"a": None, "b": "class_not_accepted", "c": "low_support"}


def test_record_items_are_cut_once(spark):
    rows = ["#x", " ", "chr1\t11\ta\tN\t<DEL>\t60\tPASS\tPRECISE;SVTYPE=INV;SVTYPE=DEL;END=900;SUPPORT=9,3;VAF=NaN;NM=.", "chr1\t11\tb\tN\t<DEL>\t60\tPASS\tSVTYPE=DEL;END=900;SUPPORT=9;NM=inf;.;", "chr1\t11\tc\tN\tN[chr2:5[\t.\tPASS\tSVTYPE=BND;SUPPORT=9;COVERAGE=1,.,3", "chr1\t11\td\tN\tN\t.\tPASS\tSVTYPE=BND;SUPPORT=9", "chr1\t11\te\tN\t<DEL>\t60\tPASS\tSVTYPE=DEL;SVTYPE;END=900"]
    df = vcf.structural_variants(lines(spark, *rows))
    got = {r["record_id"]: r for r in df.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"a": "malformed_fraction", "b": "malformed_mismatches", "c": None, "d": "malformed_breakend_alt", "e": "missing_type"}
    assert (got["a"]["event_type"], got["a"]["precise"], got["a"]["support_reads"], got["b"]["precise"]) == ("deletion", True, 9, False)
    assert (got["c"]["mate_chrom"], got["c"]["mate_pos"], got["c"]["local_coverage"]) == ("chr2", 4, 2.0)
    for rows in (df, vcf.depth_segments(lines(spark, *rows))):
        # The field is split once for the record, its items once for the map, coverage once.
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 10


def fails(df, what):
    with pytest.raises(Exception, match=what):
        df.collect()


def test_depths_must_be_the_target_set(spark):
    t = spark.createDataFrame([("chr1", 0, 10), ("chr1", 20, 30)], "chrom string, start_pos long, end_pos long")
    good = tables.target_depths(lines(spark, "1\t0\t10\t5.5", "chr1\t20\t30\tname\t7"), t)
    assert {(r["start_pos"], r["mean_depth"]) for r in good.collect()} == {(0, 5.5), (20, 7.0)}
    for bad in (["1\t0\t10\t5"], ["1\t0\t10\t5", "1\t20\t30\t5", "1\t40\t50\t5"], ["1\t0\t10\t5", "1\t0\t10\t5", "1\t20\t30\t5"]):
        fails(tables.target_depths(lines(spark, *bad), t), "not the target set")
    fails(tables.target_depths(lines(spark, "1\t0\t10\tx", "1\t20\t30\t5"), t), "malformed")


def test_maps_and_tables(spark):
    fails(tables.probe_map(lines(spark, "chr1\t0\t2\tp\t0.5", "chr2\t0\t2\tp\tNA")), "several contigs")
    fails(tables.target_gene_map(lines(spark, "target\tgene\tchrom\tresolution", "a\tg\tchr1\tlabel", "a\th\tchr1\tlabel")), "repeated target")
    fails(tables.segment_table(lines(spark, "chr1\t0\t5\t2\t0\tTRUE\tone_based")), "malformed segment")
    fails(tables.knowledge(lines(spark, '{"record_id": "a", "status": "draft"}')), "draft")
    assert tables.knowledge(lines(spark, '{"record_id": "a", "status": "draft"}'), reportable=False).count() == 1
    fails(tables.region_list(lines(spark, "chr1:0-5")), "malformed region")
    assert tables.region_list(lines(spark, "X:1-5")).collect() == [("chrX", 0, 5)]
    assert dict(tables.parameters(lines(spark, "Purity:\t0.4", "Ploidy: NA", "ID\tx")).collect()) == {"Purity": "0.4", "Ploidy": None}
    assert tables.histogram_table(lines(spark, "start\tend\tcount\tbases", "0\t10\t3\t9", "10\t\t1\t40")).collect() == [(0, 10, 3, 9), (10, None, 1, 40)]
    fits = spark.createDataFrame([(1, 0.4), (2, 0.5)], "rank int, purity double")
    assert tables.selected_fit(fits).first()["purity"] == 0.4
    fails(tables.selected_fit(fits.where("rank = 2")), "selected fit")
    units = spark.range(1, 4).select(F.col("id").cast("int").alias("unit"))
    assert tables.class_annotation(units, 3).count() == 3
    fails(tables.class_annotation(units.union(units.limit(1)), 3), "once each")


def test_states_from_intervals(spark):
    mid = lambda b: (b + 0.5) / 256
    rows = [("a", "m", mid(230), 0), ("a", "h", mid(5), 0), ("b", "m", mid(3), 0), ("b", "h", mid(4), 0), ("c", "m", mid(230), 0), ("d", "m", mid(240), 0x100), ("d", "h", mid(1), 0x100), ("e", "m", mid(100), 0), ("e", "h", mid(100), 0)]
    df = spark.createDataFrame([(r, "chr1", 5, "+", c, q, f) for r, c, q, f in rows], "read_id string, chrom string, ref_position long, ref_strand string, mod_code string, mod_qual double, flag int")
    got = {r["read_name"]: r["state"] for r in tables.explicit_calls(df).collect()}
    assert got == {"a": "M", "b": "U", "c": "A", "e": "A"}
    fails(tables.explicit_calls(df.union(df.where("read_id = 'a' AND mod_code = 'm'"))), "stands twice")
    fails(tables.explicit_calls(df.withColumn("mod_qual", F.lit(0.7))), "midpoint")
    fails(tables.explicit_calls(df.where("read_id = 'a'").withColumn("mod_qual", F.lit(mid(200)))), "exceed one")


def test_labels(spark):
    from genostrata.functions import labels

    row = spark.range(1).select(
        labels.pathology_label(F.array(F.struct(F.lit("AML").alias("name"), F.lit("A1").alias("id")), F.struct(F.lit("MDS").alias("name"), F.lit("M2").alias("id")))).alias("a"),
        labels.pathology_label(F.array().cast("array<struct<name:string,id:string>>")).alias("b"),
        labels.band(F.lit(None).cast("int"), (1, 2)).alias("c"), labels.band(F.lit(1), (1, 2)).alias("d"),
        labels.gates({"x": F.lit(5.0)}, {"x": 4.0}, {"x": 6.0})[1].alias("e"), labels.gates({}, {"x": 4.0})[1].alias("f"), labels.gates({"x": F.lit(5.0)}, {"x": 4.0})[1].alias("g"),
        labels.cellularity_tier(F.lit(None).cast("double"), 0.1, 0.2).alias("h"), labels.call_type(F.lit("hlamp")).alias("i"), labels.call_type(F.lit("NEUT")).alias("j"),
    ).first()
    assert tuple(row) == ("AML (A1); MDS (M2)", None, None, "[1,2)", "WARN", "FAIL", "PASS", None, "duplication", None)
