"""Modified bases of reads, matching within lanes, and detectable fractions against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from genostrata.functions import stats
from genostrata.operators import benchmark, lanes
from genostrata.sources import modbam

TURN = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}


def line(name="r1", flag=0, pos=1, cigar="6M", seq="ACGCGT", mm="C+m?,0,0;", ml="255,0", chrom="chr1", more=()):
    tags = [f"MM:Z:{mm}"] * (mm is not None) + [f"ML:B:C{',' if ml else ''}{ml}"] * (ml is not None)
    return "\t".join([name, str(flag), chrom, str(pos), "60", cigar, "*", "0", "0", seq, "*", *tags, *more])


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in ("@HD\tVN:1.6", "", *rows)], "value string")


def plain_decode(flag, start, cigar, seq, groups, codes):
    """Base by base: {place in the read as sequenced: (reference position, {code: byte})}."""
    at, places, number = start, [], ""
    for c in cigar:
        if c.isdigit():
            number += c
            continue
        for _ in range(int(number)):
            if c in "M=X":
                places.append(at)
                at += 1
            elif c in "IS":
                places.append(None)
            elif c in "DN":
                at += 1
        number = ""
    bases = list(zip(seq, places, strict=True))
    if flag & 16:
        bases = [(TURN[b], p) for b, p in reversed(bases)]
    told = {}
    for base, listed, deltas, values in groups:
        own = [i for i, (b, _) in enumerate(bases) if b == base]
        k = -1
        for d, row in zip(deltas, values, strict=True):
            k += d + 1
            if base == "C":
                told.setdefault(own[k], {}).update(zip(listed, row, strict=True))
    return {i: (p, told.get(i, {})) for i, (b, p) in enumerate(bases) if b == "C" and p is not None}


def test_planted_reads_equal_a_plain_decoder(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(150):
        ops = [(rng.randint(1, 4), op) for op in rng.choices("MMIDN=X", k=rng.randint(1, 6))] + [(3, "M")]
        if rng.random() < 0.5:
            ops = [(2, "H"), (2, "S"), *ops, (1, "S")]
        cigar = "".join(f"{n}{op}" for n, op in ops)
        length = sum(n for n, op in ops if op in "MIS=X")
        seq = "".join(rng.choice("ACGTCCG") for _ in range(length))
        flag, start = rng.choice([0, 16]), rng.randint(0, 1000)
        read = seq if flag == 0 else "".join(TURN[b] for b in reversed(seq))
        groups, mm, ml = [], "", []
        for base, listed in rng.choice([[("C", "mh")], [("A", "a"), ("C", "m"), ("C", "h")], [("C", "h"), ("T", "g"), ("C", "m")]]):
            own, deltas, values = read.count(base), [], []
            at = 0
            while own - at > 0 and rng.random() < 0.7:
                d = rng.randint(0, own - at - 1)
                deltas.append(d)
                values.append([rng.randint(0, 127) for _ in listed])
                at += d + 1
            groups.append((base, listed, deltas, values))
            mm += f"{base}+{listed}{rng.choice(['', '.', '?'])}{''.join(f',{d}' for d in deltas)};"
            ml += [v for row in values for v in row]
        rows.append(line(f"r{k}", flag, start + 1, cigar, seq, mm, ",".join(map(str, ml)), more=[f"MN:i:{length}"]))
        for place, (pos, told) in plain_decode(flag, start, cigar, seq, groups, "mh").items():
            want[f"r{k}", place] = ("-" if flag else "+", pos, told)
    df = lines(spark, *rows)
    got = {(r["read_name"], r["read_pos"]): (r["strand"], r["pos"], {c: v for c, v in zip("mh", r["ml"], strict=True) if v is not None}) for r in modbam.read_cytosines(df).collect()}
    assert got == want and len(want) > 300
    flat = {(r["read_name"], r["read_pos"], r["code"]): (r["low"], r["high"]) for r in modbam.modified_bases(df).collect()}
    assert flat == {(n, p, c): (v / 256, (v + 1) / 256) for (n, p), (_, _, told) in want.items() for c, v in told.items()}


def states(spark, *rows, codes=("m",), sequence="ACGCGTACGCGT"):
    sites = modbam.cpg_sites(spark.createDataFrame([("chr1", 0, sequence)], "chrom string, start_pos long, sequence string"))
    got = modbam.modified_calls(lines(spark, *rows), sites, codes).collect()
    return sorted((r["pos"], r["strand"], r["state"]) for r in got)


def test_states_on_reference_sites(spark):
    assert states(spark, line()) == [(1, "+", "M"), (3, "+", "U")]
    assert states(spark, line(flag=16)) == [(2, "-", "U"), (4, "-", "M")]
    for mm in ("C+m.,0;", "C+m?,0;", "C+m,0;"):  # what is left out is unknown
        assert states(spark, line(mm=mm, ml="255")) == [(1, "+", "M"), (3, "+", "A")]
    assert states(spark, line(mm="C+m;", ml="")) == [(1, "+", "A"), (3, "+", "A")]
    both = ("m", "h")
    assert states(spark, line(mm="C+mh?,0,0;", ml="0,255,0,0"), codes=both) == states(spark, line(mm="C+m?,0,0;C+h?,0,0;", ml="0,0,255,0"), codes=both) == [(1, "+", "A"), (3, "+", "U")]
    assert states(spark, line(seq="CCGCGT", mm="C+m?,0,0,0;", ml="255,255,0")) == [(1, "+", "M"), (3, "+", "U")]  # the first base is no site of the reference
    assert states(spark, line(flag=256, mm=None, ml=None), line(name="r2", flag=4, mm=None, ml=None)) == []
    assert states(spark, line(chrom="scaffold_1")) == []


@pytest.mark.parametrize(("row", "says"), [
    (dict(mm="C+m,4;", ml="255"), "beyond"), (dict(mm="C+m,0,0;", ml="255"), "length"), (dict(mm="C+m,0;", ml="255,0"), "length"), (dict(mm="C+m,0;", ml="256"), "bytes"), (dict(mm="C-m,0;", ml="255"), "opposite"),
    (dict(mm="N+m,0;", ml="255"), "wildcard"), (dict(mm="C+h,0;", ml="255"), "declared"), (dict(mm="A+a,0;", ml="255"), "declared"), (dict(mm="C+m,0;C+m,0;", ml="1,1"), "repeats"), (dict(mm="C+m,0", ml="255"), "grammar"),
    (dict(mm=None), "missing"), (dict(cigar="5M"), "differ in length"), (dict(cigar="2M1H3M"), "clipping"), (dict(cigar="2M2P4M"), "padding"), (dict(cigar="6M1H"), "MN"), (dict(more=["MN:i:5"]), "MN"), (dict(seq="*"), "sequence"), (dict(flag=1), "paired"),
    (dict(flag=70000), "range"), (dict(pos=0), "position"), (dict(more=["dx:i:1"]), "duplex"), (dict(more=["Mm:Z:C+m,0;"]), "old-style"), (dict(more=["MM:Z:C+m,0;"]), "repeated"), (dict(name="*"), "name"),
])
def test_broken_reads_fail_the_whole(spark, row, says):
    with pytest.raises(Exception, match=says):
        modbam.read_cytosines(lines(spark, line(name="ok"), line(**({"name": "bad"} | row))), ("m",)).collect()


def test_two_primary_alignments_of_a_read(spark):
    with pytest.raises(Exception, match="two primary"):
        modbam.read_cytosines(lines(spark, line(), line(flag=16)), ("m",)).collect()
    assert modbam.read_cytosines(lines(spark), ("m",)).count() == 0


def best_by_trying(pairs):
    """(primary pairs, all pairs) of the best matching of (truth, query, priority)."""
    best = (0, 0)
    for n in range(len(pairs) + 1):
        for some in itertools.combinations(pairs, n):
            if len({t for t, _, _ in some}) == len({q for _, q, _ in some}) == n:
                best = max(best, (sum(p == 0 for _, _, p in some), n))
    return best


def test_priorities_equal_trying_all(spark):
    rng = random.Random(3)
    rows, want = [], [0, 0]
    for g in range(40):
        kind = [rng.randint(0, 1) for _ in range(4)]
        edges = sorted({(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(rng.randint(1, 8))})
        rows += [(f"{g}t{t}", f"{g}q{q}", rng.random(), kind[q]) for t, q in edges]
        p, n = best_by_trying([(t, q, kind[q]) for t, q in edges])
        want[0] += p
        want[1] += n
    for peels in (6, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(benchmark, "PEELS", peels)
            got = benchmark.matching_by_priority(spark.createDataFrame(rows, "truth_id string, query_id string, score double, priority int")).collect()
        assert len({r["truth_id"] for r in got}) == len({r["query_id"] for r in got}) == len(got) == want[1]
        assert sum(r["priority"] == 0 for r in got) == want[0] and {tuple(r) for r in got} <= set(rows)


EVENT = "event_id string, event_type string, chrom string, start_pos long, end_pos long, copy_number double"


def test_secondary_calls_do_not_take_a_truth(spark):
    truth = spark.createDataFrame([("s1", "t1", "deletion", "chr7", 1_000_000, 6_000_000, 1.0), ("s1", "t2", "deletion", "chr7", 8_000_000, 9_000_000, 1.0)], f"specimen string, {EVENT}")
    calls = [
        ("a", "secondary", "x", "deletion", "chr7", 1_000_000, 6_000_000, 1.0), ("a", "primary", "y", "deletion", "chr7", 1_000_000, 5_000_000, 1.0), ("a", "secondary", "z", "deletion", "chr7", 8_000_000, 9_000_000, 1.0), ("a", "retained", "w", "deletion", "chr7", 8_000_000, 9_000_000, 1.0),
        ("b", "primary", "x", "deletion", "chr7", 1_000_000, 6_000_000, 2.0), ("c", "primary", "x", "deletion", "chr7", 1_000_000, 6_000_000, 1.0), ("d", "primary", "x", "deletion", "chr7", 1_000_000, 6_000_000, 1.0),
    ]
    found = spark.createDataFrame(calls, f"lane string, contribution string, {EVENT}")
    records = [("a", "s1", "run_summary", "observed"), ("a", "s1", "segment", "observed"), ("b", "s1", "run_summary", "observed"), ("c", "s1", "run_summary", "failed"), ("d", "s2", "run_summary", "observed")]
    known = lanes.lane_outcomes(spark.createDataFrame(records, "lane string, specimen string, kind string, outcome string"))
    matches = lanes.lane_matches(known, truth, found, min_overlap=0.5, copy_number_tolerance=0.5)
    assert {(r["lane"], r["truth_id"], r["query_id"], r["priority"]) for r in matches.collect()} == {("a", "t1", "y", 0), ("a", "t2", "z", 1)}
    report = {r["lane"]: tuple(r)[1:] for r in lanes.lane_report(known, truth, found, matches).collect()}
    assert report == {"a": ("observed", 1, 0, 1, 1), "b": ("observed", 0, 1, 2, 0), "c": ("failed", None, None, None, None), "d": ("observed", 0, 1, 0, 0)}


@pytest.mark.parametrize(("records", "says"), [([("a", "s", "segment", "observed")], "summary"), ([("a", "s", "run_summary", "observed")] * 2, "summary"), ([("a", "s", "run_summary", "observed"), ("a", "s", "segment", "failed")], "outcome"), ([("a", "s", "run_summary", "observed"), ("a", "x", "segment", "observed")], "specimen")])
def test_lanes_that_do_not_hold_together(spark, records, says):
    with pytest.raises(Exception, match=says):
        lanes.lane_outcomes(spark.createDataFrame(records, "lane string, specimen string, kind string, outcome string")).collect()


def plain_fraction(depth, reads, power):
    from math import comb

    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if sum(comb(depth, i) * p**i * (1 - p) ** (depth - i) for i in range(reads)) <= 1 - power:
            high = p
        else:
            low = p
    return high


def test_detectable_fractions_equal_a_search(spark):
    depths = [2, 3, 7, 20, 30, 80, 250, 900]
    rows = spark.createDataFrame([(d,) for d in depths], "depth int")
    reads = stats.min_variant_reads(rows, 0.01, 0.01)
    got = {r["depth"]: (r["min_reads"], r["min_vaf"]) for r in stats.min_detectable(reads, power=0.9).collect()}
    for d in depths:
        needed, vaf = got[d]
        assert vaf is None if needed > d else vaf == pytest.approx(plain_fraction(d, needed, 0.9), rel=1e-9)
    assert len(got) == len(depths) and got[900][1] < got[250][1] < got[30][1]
    strict = stats.min_detectable(stats.min_variant_reads(rows, 0.3, 1e-6)).where("depth <= 7").collect()
    assert all(r["min_vaf"] is None for r in strict)
    clone = spark.createDataFrame([(0.1, 0.5), (0.1, 0.1), (0.1, 0.0), (0.1, 1.5), (None, 0.5)], "v double, f double").select(stats.detectable_clone(F.col("v"), F.col("f")).alias("c"))
    assert [r["c"] for r in clone.collect()] == [pytest.approx(0.4), None, None, None, None]


def test_tails_of_great_depths(spark):
    got = dict(stats.min_variant_reads(spark.createDataFrame([(100_000,), (5000,)], "depth int"), 0.01, 0.01).collect())
    from math import lgamma, log

    def tail(k, n):
        import math

        return math.fsum(math.exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(0.01) + (n - i) * log(0.99)) for i in range(k, min(n, 4000) + 1))

    for n, k in got.items():
        assert tail(k, n) <= 0.01 < tail(k - 1, n)
