"""Lane orders, serial numbers of clusters, runs, dispositions, roll-ups and locks on small cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from genostrata.operators import consensus, methylation, metrics, planning, segments, validators
from genostrata.operators.running import with_serial
from genostrata.operators.scratch import Tables

NODE, EDGE = "plan string, node string, payload string", "plan string, parent string, child string"


def ordered(spark, nodes, edges):
    return planning.ordered_lanes(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()


def test_least_order_and_bound_hashes(spark):
    nodes = [("p", n, f"of {n}") for n in "edcba"] + [("q", "a", None)]
    edges = [("p", "e", "a"), ("p", "d", "b"), ("p", "e", "b"), ("p", "e", "b")]
    got = {(r["plan"], r["node"]): (r["place"], r["hash"]) for r in ordered(spark, nodes, edges)}
    assert [n for _, n in sorted((v[0], k[1]) for k, v in got.items() if k[0] == "p")] == ["c", "d", "e", "a", "b"]
    h = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    d, e = h("d", "of d"), h("e", "of e")
    assert got["p", "b"][1] == h("b", "of b", f"d={d}", f"e={e}") and got["q", "a"] == (1, h("a", ""))
    changed = {r["node"]: r["hash"] for r in ordered(spark, [(p, n, "new" if n == "e" else x) for p, n, x in nodes if p == "p"], edges)}
    assert {n for n in "abcde" if changed[n] != got["p", n][1]} == {"a", "b", "e"}


@pytest.mark.parametrize(("nodes", "edges", "says"), [
    ([("p", "a", ""), ("p", "a", "")], [], "twice"), ([("p", "a", "")], [("p", "x", "a")], "parent x"), ([("p", "a", "")], [("p", "a", "x")], "absent lane x"), ([("p", "a", ""), ("p", "b", "")], [("p", "a", "b"), ("p", "b", "a")], "circle"),
])
def test_plans_that_have_no_order(spark, nodes, edges, says):
    with pytest.raises(Exception, match=says):
        ordered(spark, nodes, edges)


def test_serial_numbers_over_ranges(spark):
    rows = [(random.Random(k).random(), k) for k in range(500)]
    with Tables(spark) as tables:
        got = with_serial(spark.createDataFrame(rows, "x double, k long").repartition(5), ["x", "k"], "n", tables).collect()
        assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == [k for _, k in sorted(rows)] and sorted(r["n"] for r in got) == list(range(1, 501))


def test_clusters_are_numbered_by_locus(spark):
    rows = [("b", "deletion", "chr10", 100, 900, "one", 5), ("a", "deletion", "chr2", 100, 900, "one", 5), ("c", "deletion", "chr2", 110, 905, "two", 9), ("d", "deletion", "chr2", 90_000, 95_000, "two", 3), ("e", "inversion", "chr1", 5, 900, "one", 2)]
    df = spark.createDataFrame(rows, "event_id string, event_type string, chrom string, start_pos long, end_pos long, caller string, support_reads int")
    got = {r["cluster_id"]: r for r in consensus.merged(df, consensus.cluster_calls(df)).collect()}
    assert {k: r["sources"] for k, r in got.items()} == {"SVCLUSTER-000001": ["a", "c"], "SVCLUSTER-000002": ["d"], "SVCLUSTER-000003": ["b"], "SVCLUSTER-000004": ["e"]}
    first = got["SVCLUSTER-000001"]
    assert (first["representative"], first["callers"], first["n_members"], first["status"]) == ("c", "one,two", 2, "technically_supported")
    assert [tuple(e) for e in first["evidence"]] == [("a", "one", 5), ("c", "two", 9)]


def test_runs_go_on_over_pieces(spark, monkeypatch):
    rng = random.Random(9)
    calls = [rng.choice([None, 1.0, 1.0, 2.0]) for _ in range(300)]
    bins = spark.createDataFrame([("chr1", k, k * 10, k * 10 + 10, c, 2.0) for k, c in enumerate(calls)], "chrom string, bin long, start_pos long, end_pos long, call double, copy_number double")
    want, last = [], object()
    for k, c in enumerate(calls):
        if (c or 0.0) != last:
            want.append([k * 10, 0])
            last = c or 0.0
        want[-1][1] = k * 10 + 10
    for size in (7, 10_000):
        monkeypatch.setattr(segments, "BINS", size)
        assert sorted([r["start_pos"], r["end_pos"]] for r in segments.collapse(bins).collect()) == want


def test_first_of_a_fragment_and_null_classes(spark):
    rows = spark.createDataFrame([(k, "+8" if k % 3 else None) for k in range(30)], "id long, fragment string")
    got = {r["id"]: r["disposition"] for r in segments.dispositions(rows, ["id"]).collect()}
    assert got == {k: "OMITTED" if k % 3 == 0 else "RENDERED" if k == 1 else "DUPLICATE" for k in range(30)}
    scores = spark.createDataFrame([(None, "f", "l", 0.5), ("c", None, "l", 0.3), ("c", "f", None, 0.2)], "class string, family string, lineage string, score double")
    rolled = {(r["level"], r["label"]): r["score"] for r in methylation.class_rollup(scores).collect()}
    assert rolled == {("class", None): 0.5, ("class", "c"): 0.5, ("family", "f"): 0.7, ("family", None): 0.3, ("lineage", "l"): 0.8, ("lineage", None): 0.2}


def test_samples_and_locks(spark, monkeypatch):
    keys = spark.range(200).select(F.col("id").alias("k"))
    levels = spark.createDataFrame([("a", 20), ("b", 500), ("c", 0)], "level string, n long")
    want = {("a", k) for k in sorted(range(200), key=lambda k: (hashlib.md5(f"5|a|{k}".encode()).hexdigest(), k))[:20]} | {("b", k) for k in range(200)}
    assert {(r["level"], r["k"]) for r in metrics.sampled(keys, "k", levels, 5).collect()} == want
    monkeypatch.setattr(metrics, "MOST_LEVELS", 0)
    assert {(r["level"], r["k"]) for r in metrics.sampled(keys, "k", levels, 5).collect()} == want
    panel = spark.createDataFrame([("chr1", 1, 5, "x"), ("chr2", 2, 9, "y")], "chrom string, start_pos long, end_pos long, label string")
    lock = validators.panel_facts(panel).first().asDict()
    assert validators.panel_lock(panel, **lock, role="selection", declared="selection").count() == 0
    other = validators.panel_lock(panel.where("label = 'x'"), **lock, role="a", declared="b").collect()
    assert {r["rule"] for r in other} == {"row_count", "label_count", "content", "role"}
