"""Points among intervals: few pairs that miss, pieces looked for by cells, and checks that work nothing out anew."""

import random

from pyspark.sql import functions as F

from genostrata.operators import rangejoin, stored_intervals
from genostrata.plans import stored
from genostrata.sources import annotation

SPANS = "r_chrom string, r_start long, r_end long, name string"


def test_points_meet_intervals_of_all_lengths_once(spark, monkeypatch):
    rng = random.Random(11)
    spans = [(rng.choice(["chr1", "chr2"]), s, s + rng.choice([0, 1, 40, 9_000, 300_000, 20_000_000]), f"i{k}") for k, s in enumerate(rng.randrange(400_000) for _ in range(300))]
    spans += [(None, 0, 10, "n"), ("chr1", None, 10, "n")]
    points = [(rng.choice(["chr1", "chr2", None]), rng.choice([None, rng.randrange(400_000)]), k) for k in range(500)]
    points += [(c, s, 1000 + k) for k, (c, s, e, _) in enumerate(spans[:50])] + [(c, e, 2000 + k) for k, (c, s, e, _) in enumerate(spans[:50])]

    def refuse(*_, **__):
        raise AssertionError("points posted as intervals")

    monkeypatch.setattr(rangejoin, "overlap_join", refuse)
    got = rangejoin.point_join(spark.createDataFrame(points, "l_chrom string, l_pos long, id long"), spark.createDataFrame(spans, SPANS)).select("id", "name").collect()
    want = [(i, name) for c, p, i in points for d, s, e, name in spans if c and c == d and p is not None and s is not None and s <= p < e]
    assert want and sorted(map(tuple, got)) == sorted(want)
    none = rangejoin.point_join(spark.createDataFrame(points, "l_chrom string, l_pos long, id long"), spark.createDataFrame([], SPANS))
    assert none.count() == 0


def test_pieces_are_looked_for_by_cells_of_points(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.lit("chr1").alias("chrom"), (F.col("id") * 1000).alias("start_pos"), (F.col("id") * 1000 + 900).alias("end_pos"), F.col("id").cast("string").alias("label"))
    version = stored_intervals.store_intervals(rows, f"file://{tmp_path}/index", piece_rows=50)
    looked = []
    whole = stored_intervals.overlap_join
    monkeypatch.setattr(stored_intervals, "overlap_join", lambda l, r: (looked.append(l.count()), whole(l, r))[1])
    points = spark.range(3000).select(F.lit("chr1").alias("l_chrom"), (F.col("id") + 5000).alias("l_pos"), "id")
    got = {(r["id"], r["label"]) for r in stored_intervals.stored_point_join(points, version).collect()}
    assert got == {(i, str((i + 5000) // 1000)) for i in range(3000) if (i + 5000) % 1000 < 900}
    assert looked[0] <= 2


def test_checks_stand_above_what_they_read(spark):
    lines = spark.createDataFrame([('chr1\tx\tgene\t1\t9\t.\t+\t.\tgene_id "G"; tag "b"; tag "a"; gene_name "N = 1";x=y',)], "value string")
    features = annotation.gtf_features(lines)
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3  # the checks together used to cut each line some thirty times
    (row,) = features.collect()
    assert (row["gene_id"], row["gene_name"], row["tags"], row["start_pos"], row["transcript_id"]) == ("G", "N = 1", ["a", "b"], 0, None)
    assert annotation.gtf_features(stored.gene_lines(spark, "/root/testdata/sf0.001")).where("feature = 'exon' AND exon_number IS NULL").isEmpty()
