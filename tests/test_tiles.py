"""Totals over regions from sums within tiles, against all pairs, with sides longer than a tile and without."""

import random

import pytest
from pyspark.sql import functions as F

from genostrata.operators import coverage, methylation, rangejoin, tiles


def refuse(*_, **__):
    raise AssertionError("a join of all overlapping pairs")


@pytest.mark.parametrize("long", [False, True])
def test_overlaps_by_label(spark, monkeypatch, long):
    monkeypatch.setattr(tiles, "TILE", 1000)
    monkeypatch.setattr(coverage, "TILE", 1000)
    if not long:
        monkeypatch.setattr(coverage, "overlap_join", refuse)
    rng = random.Random(7)
    span = lambda: (rng.choice(["chr1", "chr2"]), s := rng.randrange(0, 9000), s + rng.choice([0, 1, 40, 400, 1000, *([2600] if long else [])]))  # noqa: E731, F841
    calls = [(*span(), rng.choice("xy"), rng.choice([None, *range(9)])) for _ in range(500)]
    regions = [(*span(), i, rng.random()) for i in range(90)] + [("chr3", 5, 9, 900, 0.5)]
    c = spark.createDataFrame(calls, "l_chrom string, l_start long, l_end long, label string, value int")
    r = spark.createDataFrame(regions, "r_chrom string, r_start long, r_end long, id long, mean_depth double")
    want = {}
    for chrom, s, e, i, depth in regions:
        for k in "xy":
            met = [x for x in calls if x[0] == chrom and x[3] == k and x[1] < x[2] and x[1] < e and s < x[2] and s < e]
            if met:
                known = [x[4] for x in met if x[4] is not None]
                want[i, k] = (len(met), max(known) if known else None, sum(min(x[2], e) - max(x[1], s) for x in met), depth)
    got = {(x["id"], x["label"]): (x["n_calls"], x["most"], x["overlap_bp"], x["depth"]) for x in coverage.overlaps_by_label(c, r, ["id"]).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("long", [False, True])
def test_region_summary(spark, monkeypatch, long):
    monkeypatch.setattr(tiles, "TILE", 1000)
    monkeypatch.setattr(methylation, "TILE", 1000)
    rng = random.Random(8)
    sites = [(rng.choice(["chr1", "chr2"]), rng.randrange(9000), rng.choice("mhz"), v := rng.randint(1, 12), rng.choice([None, *range(v + 1)])) for _ in range(900)]
    regions = [(i, rng.choice(["chr1", "chr2"]), s := rng.randrange(9000), s + rng.choice([1, 50, 900, *([2600] if long else [])])) for i in range(60)]
    if long:
        regions.append((5, "chr2", 100, 300))  # an id in two places is one region
    else:
        monkeypatch.setattr(methylation, "point_join", refuse)
    s = spark.createDataFrame(sites, "chrom string, pos long, code string, valid_coverage long, modified_calls long")
    r = spark.createDataFrame(regions, "target_id long, chrom string, start_pos long, end_pos long")
    spans = r.select(F.col("chrom").alias("r_chrom"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), "target_id")
    met = rangejoin.point_join(s.withColumnsRenamed({"chrom": "l_chrom", "pos": "l_pos"}), spans).groupBy("target_id", "code")
    ok = lambda c: F.when(F.col("valid_coverage") >= 5, c)
    plain = met.agg(F.count(F.lit(1)).alias("n"), F.count(ok(F.lit(1))).alias("used"), F.sum(ok(F.col("valid_coverage"))).alias("v"), F.sum(ok(F.col("modified_calls"))).alias("m"), F.round(F.median(ok(F.col("modified_calls") / F.col("valid_coverage"))), 9).alias("median"))
    want = {(x["target_id"], x["code"]): (x["n"], x["used"], x["v"] or 0, x["m"] or 0, x["median"]) for x in plain.collect() if x["code"] != "z"}
    got = {(x["target_id"], x["code"]): (x["n_sites"], x["n_used"], x["valid"], x["modified"], x["median_fraction"]) for x in methylation.region_summary(s, r, ("m", "h"), 5).collect()}
    assert len(want) > 40 and got == {(i, k): want.get((i, k), (0, 0, 0, 0, None)) for i, *_ in regions for k in "mh"}


def test_every_rank_of_a_range():
    import numpy as np

    rng = np.random.default_rng(3)
    ranks = rng.integers(0, 9, 50)
    for lo in range(0, 50, 7):
        for hi in range(lo + 1, 50, 5):
            n = np.arange(hi - lo)
            assert tiles.range_kth(ranks, np.full(len(n), lo), np.full(len(n), hi), n).tolist() == sorted(ranks[lo:hi].tolist())
