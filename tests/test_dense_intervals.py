"""Dense tables: intervals over each other many times, and reads whose bases fall on sites of others."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def crowded_events(spark, tmp_path_factory):
    """Events whose reads overlap on one contig: each id lies a few bases after another one."""
    d = tmp_path_factory.mktemp("events")
    rows = spark.range(3000).select((F.expr("id % 60") * 5_000_000 + F.expr("id div 60")).alias("event_id"), F.lit(22).cast("long").alias("user_id"))
    # 7919 * id mod 5,000,000 is then 7919 * (id div 60); ids 1 apart in units of its inverse are neighbours.
    step = pow(7919, -1, 5_000_000)
    rows = rows.select((F.col("event_id") * step % 5_000_000 + 5_000_000 * F.expr("event_id div 5000000")).alias("event_id"), "user_id")
    rows.write.parquet(f"{d}/events.parquet")
    return str(d)


def test_modified_base_calls_of_crowded_reads(spark, crowded_events):
    import duckdb
    from genostrata.plans import catalogue
    from oracle import rows_of

    df = catalogue.QUERIES["modified_base_calls"](spark, crowded_events)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{crowded_events}/events.parquet/*.parquet'")
    res = con.sql(catalogue.ORACLES["modified_base_calls"])
    assert got and got == rows_of(res.columns, res.fetchall())


SPANS = [(c, s, s + random.Random(s).randint(1, 900), f"g{s % 5}", float(s % 40)) for c in ("chr1", "chr2") for s in range(0, 4000, 7)]


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame(SPANS, "r_chrom string, r_start long, r_end long, r_label string, depth double")


def unpaired(monkeypatch, *modules):
    """Pairs of all intervals over each other are what may not be made."""

    def refuse(*_, **__):
        raise AssertionError("a join of all overlapping pairs")

    for module, name in modules:
        monkeypatch.setattr(module, name, refuse)


def test_nearest_forms_no_overlapping_pairs(spark, spans, monkeypatch):
    from genostrata.operators import rangejoin

    points = [(i, "chr1" if i % 2 else "chr2", p, p + w) for i, (p, w) in enumerate((p, w) for p in range(0, 6000, 97) for w in (1, 40))]
    unpaired(monkeypatch, (rangejoin, "overlap_join"))
    got = {tuple(r) for r in rangejoin.nearest(spark.createDataFrame(points, "l_id long, l_chrom string, l_start long, l_end long"), spans.drop("depth"), span=500).collect()}
    distance = lambda s, e, a, b: 0 if s < b and a < e else min(abs(s - b), abs(a - e))
    assert got == {(i, *min((distance(s, e, a, b), a, b, g) for k, a, b, g, _ in SPANS if k == c)) for i, c, s, e in points}


def test_merged_intervals_and_observability(spark, spans, monkeypatch):
    from genostrata.operators import coverage, rangejoin

    merged = rangejoin.merged_intervals(spans, ["r_label"]).collect()
    cover = lambda rows: {(c, g, x) for c, a, b, g in rows for x in range(a, b)}
    assert cover((r["r_chrom"], r["r_start"], r["r_end"], r["r_label"]) for r in merged) == cover(x[:4] for x in SPANS)
    ends = {}
    for r in merged:
        ends.setdefault((r["r_chrom"], r["r_label"]), []).append((r["r_start"], r["r_end"]))
    assert all(x[1] < y[0] for v in ends.values() for x, y in zip(sorted(v), sorted(v)[1:]))
    widest = []
    whole = coverage.overlap_join
    monkeypatch.setattr(coverage, "overlap_join", lambda l, r: (widest.append(r.count()), whole(l, r))[1])
    events = [(i, "deletion", "chr1", 50 * i, 50 * i + 333) for i in range(110)]
    targets = spans.select(F.col("r_chrom").alias("chrom"), F.col("r_start").alias("start_pos"), F.col("r_end").alias("end_pos"), F.when(F.col("depth") != 7, F.col("depth")).alias("mean_depth"))
    got = {r["event_id"]: r["observability"] for r in coverage.observability(spark.createDataFrame(events, "event_id long, event_type string, chrom string, start_pos long, end_pos long"), targets, 39.0).collect()}
    assert widest[0] < len(SPANS) / 4  # every region stood in the join before
    deepest = lambda p: max((d for c, a, b, _, d in SPANS if c == "chr1" and a <= p < b and d != 7), default=None)
    for i, _, _, s, e in events:
        two = [deepest(s), deepest(e - 1)]
        want = "outside_target" if two == [None, None] else "partially_observed" if None in two else "observed_adequately" if min(two) >= 39 else "insufficient_coverage"
        assert got[i] == want


def test_unmatched_calls_form_no_pairs(spark, monkeypatch):
    from genostrata.operators import benchmark

    rows = [(f"{c}{i}", k, "chr1", 37 * i % 9000, 37 * i % 9000 + 200 + i % 700, c) for c in "tq" for i in range(c == "q", 400, 2) for k in ("deletion", "inversion")[i % 3 == 0 :][:1]]
    calls = spark.createDataFrame(rows, "event_id string, event_type string, chrom string, start_pos long, end_pos long, side string")
    t, q = calls.where("side = 't'"), calls.where("side = 'q'")
    want = {r["truth_id"] for r in benchmark.span_candidates(t, q, 0.5).collect()}
    unpaired(monkeypatch, (benchmark, "overlap_join"))
    got = [r["event_id"] for r in benchmark.span_matched(t, q, 0.5).collect()]
    assert 0 < len(want) < 200 and sorted(got) == sorted(want)


def test_pairs_within_a_distance_are_not_grouped(spark):
    from genostrata.operators import benchmark

    one = [(f"e{i}", "translocation", "chr1", 10 * i, 10 * i + 1, f"chr{1 + i % 2}", 10 * (i % 9), 10 * (i % 9) + 1) for i in range(60)]
    names = "event_id string, event_type string, chrom string, start_pos long, end_pos long, chrom2 string, start2 long, end2 long"
    t = spark.createDataFrame(one + one[:3], names)
    q = spark.createDataFrame([(f"q{x[0]}", *x[1:]) for x in one] + [("qe1", *one[5][1:])], names)
    found = benchmark.distance_candidates(t, q, 50)
    want = {}
    for a in one:
        for b in [*one, ("e1", *one[5][1:])]:
            gap = lambda *p: max(abs(x - y) for x, y in p)
            here = [gap((a[3], b[3]), (a[4], b[4]), (a[6], b[6]), (a[7], b[7]))] if (a[2], a[5]) == (b[2], b[5]) else []
            here += [gap((a[3], b[6]), (a[4], b[7]), (a[6], b[3]), (a[7], b[4]))] if (a[2], a[5]) == (b[5], b[2]) else []
            if here and min(here) <= 50:
                want[a[0], "q" + b[0]] = min(here + [want.get((a[0], "q" + b[0]), 99)])
    rows = found.collect()
    assert len(rows) == len(want) and {(r["truth_id"], r["query_id"]): r["distance"] for r in rows} == want
    plain = benchmark.distance_candidates(t.drop("chrom2", "start2", "end2"), q.drop("chrom2", "start2", "end2"), 50)
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_mutual_best_ranks_no_pairs(spark):
    from genostrata.operators import benchmark

    rng = random.Random(5)
    rows = [(f"t{t}", f"q{q}", rng.randint(1, 4) / 4) for t in range(30) for q in range(30) if rng.random() < 0.4]
    found = benchmark.mutual_best(spark.createDataFrame(rows, "truth_id string, query_id string, score double"))
    first = lambda side, other, k: min((-x[2], x[other]) for x in rows if x[side] == k)[1]
    want = {x for x in rows if first(0, 1, x[0]) == x[1] and first(1, 0, x[1]) == x[0]}
    assert want and {tuple(r) for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_calls_of_other_types_do_not_meet(spark, monkeypatch):
    from genostrata.operators import benchmark

    rows = [(f"e{i}", ("deletion", "inversion", None)[i % 3], "chr1", 10 * i, 10 * i + 500, 2.0 + i % 2) for i in range(60)]
    calls = spark.createDataFrame(rows, "event_id string, event_type string, chrom string, start_pos long, end_pos long, copy_number double")
    whole, met = benchmark.overlap_join, []
    monkeypatch.setattr(benchmark, "overlap_join", lambda l, r, **k: met.append(whole(l, r, **k)) or met[0])
    got = {(r["truth_id"], r["query_id"]) for r in benchmark.span_candidates(calls, calls, 0.5, 0.5).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and abs(a[3] - b[3]) <= 250 and a[5] == b[5]}
    assert met[0].count() == sum(a[1] is not None and a[1] == b[1] and abs(a[3] - b[3]) < 500 for a in rows for b in rows)
