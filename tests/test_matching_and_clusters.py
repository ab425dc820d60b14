"""Clusters, matchings and breakpoints against plain versions and literal cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from genostrata.operators import audit, benchmark, consensus, coverage, metrics, mixture, planning

PAIR = "event_id string, event_type string, chrom string, start_pos long, end_pos long, chrom2 string, start2 long, end2 long, caller string, orientations array<string>"


def plain_clusters(calls, policy):
    """One pass over all calls in order: each joins the first head that it matches."""

    def ordered(c):
        one, two = (int(c[2][3:]), c[3], c[4]), (int(c[5][3:]), c[6], c[7])
        swapped = two < one
        return (*(two if swapped else one), *(one if swapped else two)), {s[::-1] if swapped else s for s in c[9] or []}

    heads, found = [], {}
    for c in sorted(calls, key=lambda c: (c[1], ordered(c)[0], c[0])):
        (a, s, e, b, s2, e2), strands = ordered(c)
        for h in heads:
            (ha, hs, he, hb, hs2, he2), hstrands = ordered(h)
            if h[1] != c[1] or (ha, hb) != (a, b) or (not policy.merge_within_caller and h[8] == c[8]) or (strands and hstrands and not strands & hstrands):
                continue
            if max(abs(s - hs), abs(e - he), abs(s2 - hs2), abs(e2 - he2)) <= policy.max_distance:
                found[c[0]] = h[0]
                break
        else:
            heads.append(c)
            found[c[0]] = c[0]
    return found


@pytest.mark.parametrize("within", [True, False])
def test_translocation_clusters(spark, within):
    rng = random.Random(3)
    calls = []
    for i in range(400):
        loci = [(f"chr{rng.randint(1, 2)}", rng.randint(0, 40) * 60) for _ in range(2)]
        calls.append((f"e{i:03d}", "translocation", loci[0][0], loci[0][1], loci[0][1] + 1, loci[1][0], loci[1][1], loci[1][1] + 1, rng.choice("xy"), rng.choice([None, ["+-"], ["-+"], ["++"]])))
    policy = consensus.Policy(max_distance=100, merge_within_caller=within)
    want = plain_clusters(calls, policy)
    got = {r["event_id"]: r["head"] for r in consensus.cluster_calls(spark.createDataFrame(calls, PAIR), policy, tile=300).collect()}
    assert got == want and 50 < len(set(want.values())) < 400


def test_dense_tiles_give_one_pass(spark):
    """A chain of calls without a gap over many tiles."""
    calls = [(f"e{i:05d}", "deletion", "chr1", 7 * i, 7 * i + 2000 + i % 13) for i in range(3000)]
    df = spark.createDataFrame(calls, "event_id string, event_type string, chrom string, start_pos long, end_pos long")
    want, heads = {}, []
    for e, _, _, s, x in calls:
        for h, hs, hx in heads[-200:]:
            if max(abs(s - hs), abs(x - hx)) <= 500 and max(0, min(x, hx) - s) / max(x - s, hx - hs) >= 0.5:
                want[e] = h
                break
        else:
            heads.append((e, s, x))
            want[e] = e
    assert {r["event_id"]: r["head"] for r in consensus.cluster_calls(df, tile=600).collect()} == want


def test_largest_matching_equals_trying_all():
    rng = random.Random(5)
    for _ in range(60):
        edges = {(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(rng.randint(1, 9))}
        options = {}
        for t, q in sorted(edges):
            options.setdefault(t, []).append(q)
        best = max(len(s) for n in range(len(edges) + 1) for s in itertools.combinations(edges, n) if len({t for t, _ in s}) == len({q for _, q in s}) == len(s))
        got = benchmark.largest_matching(options)
        assert len(got) == best and all((t, q) in edges for q, t in got.items()) and len(set(got.values())) == len(got)


def test_swapped_loci_match(spark):
    kind = "event_id string, event_type string, chrom string, start_pos long, end_pos long, chrom2 string, start2 long, end2 long"
    truth = spark.createDataFrame([("t1", "translocation", "chr1", 100, 101, "chr2", 900, 901), ("t2", "translocation", "chr1", 5000, 5001, None, None, None)], kind)
    found = spark.createDataFrame([("q1", "translocation", "chr2", 905, 906, "chr1", 102, 103), ("q2", "translocation", "chr1", 5000, 5001, "chr3", 5, 6), ("q3", "translocation", "chr1", 5004, 5005, None, None, None)], kind)
    got = {(r["truth_id"], r["query_id"]): r["distance"] for r in benchmark.distance_candidates(truth, found, 50).collect()}
    assert got == {("t1", "q1"): 5, ("t2", "q3"): 4}


def test_empty_strata_are_reported(spark):
    truth = spark.createDataFrame([("a", "deletion")], "event_id string, event_type string")
    pairs = spark.createDataFrame([("a", "b", 1.0)], "truth_id string, query_id string, score double")
    strata = spark.createDataFrame([("deletion",), ("inversion",)], "event_type string")
    got = {r["event_type"]: r for r in benchmark.confusion(truth, spark.createDataFrame([("b", "deletion")], truth.schema), pairs, ["event_type"], strata).collect()}
    assert got["inversion"]["tp"] == got["inversion"]["fn"] == 0 and got["inversion"]["precision"] is None and got[None]["tp"] == 1


def test_observability_states(spark):
    targets = spark.createDataFrame([("chr1", 0, 1000, 30.0), ("chr1", 500, 1000, 50.0), ("chr1", 5000, 6000, 5.0), ("chr1", 9000, 9100, 40.0), ("chr2", 0, 100, 40.0)], "chrom string, start_pos long, end_pos long, mean_depth double")
    rows = [("both", "deletion", "chr1", 600, 9050, None, None, None), ("one", "deletion", "chr1", 600, 3000, None, None, None), ("none", "deletion", "chr1", 2000, 3000, None, None, None), ("thin", "inversion", "chr1", 600, 5500, None, None, None), ("ins", "insertion", "chr1", 700, 99_000, None, None, None), ("inner", "deletion", "chr1", 1500, 12_000, None, None, None), ("pair", "translocation", "chr1", 10, 11, "chr2", 50, 51), ("half", "translocation", "chr1", 10, 11, "chr2", 500, 501)]
    events = spark.createDataFrame(rows, "event_id string, event_type string, chrom string, start_pos long, end_pos long, chrom2 string, start2 long, end2 long")
    got = {r["event_id"]: r["observability"] for r in coverage.observability(events, targets, 20.0).collect()}
    assert got == {"both": "observed_adequately", "one": "partially_observed", "none": "outside_target", "thin": "insufficient_coverage", "ins": "observed_adequately", "inner": "outside_target", "pair": "observed_adequately", "half": "partially_observed"}
    wide = {r["event_id"]: r["observability"] for r in coverage.observability(events, targets, 20.0, buffered=True).collect()}
    assert wide["both"] == "partially_observed" and wide["thin"] == "insufficient_coverage" and wide["none"] == "outside_target"
    assert {r["observability"] for r in coverage.observability(events, targets, 20.0, assessed=False).collect()} == {"not_applicable"}


def test_graph_depth_nulls_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(3, None), (None, 4), (0, 100)], "parent long, child long")
    got = {r["node"]: r["level"] for r in audit.levels(edges, spark.range(121).withColumnRenamed("id", "node")).collect()}
    assert got == {i: i for i in range(121)}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "parent long, child long")
    with pytest.raises(ValueError, match="cycle"):
        audit.levels(loop, spark.createDataFrame([(1,), (2,), (3,)], "node long"))
    nodes = spark.createDataFrame([(1, "FAILED"), (2, "COMPLETED"), (3, "COMPLETED")], "node long, outcome string")
    assert dict(audit.blocked(loop, nodes).collect()) == {1: "FAILED", 2: "NOT_RUN", 3: "NOT_RUN"}


def test_dependencies_pass_through_unused_nodes(spark):
    nodes = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "node long, used boolean")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "parent long, child long")
    assert planning.effective_edges(nodes, edges).collect() == [(4, 1)]


def test_draws_lie_around_the_fit(spark):
    markers = spark.createDataFrame([(i, 95, 5, 5, 95, 0, 0) for i in range(60)], "marker_id long, ma long, ua long, mb long, ub long, aa long, ab long")
    seen = spark.createDataFrame([("x", i, 32, 68, 0) for i in range(60)] + [("y", i, 95, 5, 4) for i in range(60)], "level string, marker_id long, m long, u long, a long")
    got = {r["level"]: r for r in mixture.interval_draws(markers, seen).collect()}
    assert got["x"]["n_draws"] == 500 and got["x"]["low"] < 0.3 < got["x"]["high"] and got["x"]["high"] - got["x"]["low"] < 0.05
    assert got["y"]["high"] == 1.0
    gates = mixture.level_gates(spark.createDataFrame([("x", 60, 0.3, 1.0), ("few", 3, 0.3, 1.0), ("out", 60, 1.4, 1.0), ("bad", 60, 0.5, 9.0)], "level string, n_markers long, raw double, rmse double"), spark.range(1).select(F.lit(60).alias("n")))
    assert {r["level"]: r["reason"] for r in gates.collect()} == {"x": None, "few": "few_markers_used", "out": "extrapolated", "bad": "poor_fit"}


def test_samples_are_without_replacement(spark):
    keys = spark.range(5000).withColumnRenamed("id", "key")
    levels = spark.createDataFrame([("a", 10), ("b", 3000), ("c", 5000)], "level string, n long")
    got = metrics.sampled(keys.union(keys), "key", levels, 3).groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("key").alias("d")).collect()
    assert {r["level"]: (r["n"], r["d"]) for r in got} == {"a": (10, 10), "b": (3000, 3000), "c": (5000, 5000)}


def test_structural_path_keeps_filters_and_clusters(spark):
    from genostrata.operators import compose

    calls = [("a", "deletion", "chr1", 100, 1100, "x", 9, 0.2, "PASS"), ("b", "deletion", "chr1", 140, 1140, "y", 25, 0.3, "PASS"), ("c", "deletion", "chr1", 150, 1150, "z", 30, 0.3, "LOWQ"), ("d", "insertion", "chr2", 50, 51, "x", 2, 0.3, "PASS")]
    df = spark.createDataFrame(calls, "event_id string, event_type string, chrom string, start_pos long, end_pos long, caller string, support_reads int, vaf double, filter string")
    targets = spark.createDataFrame([("chr1", 0, 600, "G1", 40.0), ("chr1", 1000, 2000, "G2", 40.0)], "chrom string, start_pos long, end_pos long, label string, mean_depth double")
    (row,) = compose.structural_path(df, targets, min_support=5, min_depth=20.0).collect()
    assert (row["event_id"], row["callers"], row["genes"], row["observability"], row["n_members"]) == ("b", "x,y", "G1,G2", "observed_adequately", 2) and row["confidence"] == "high"
