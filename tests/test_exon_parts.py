"""Points in exons and introns are not grouped by transcript unless their id stands in several points."""

import random

from genostrata.operators import annotate


def plain(points, exons):
    """The least (kind, number) of each point and transcript, by trying all parts."""
    parts = {}
    for t in {e[0] for e in exons}:
        own = sorted((e[2:] + (e[1],) for e in exons if e[0] == t), key=lambda e: (e[0] is not None, e[0] or 0, *e[1:]))
        parts[t] = [(c, 0, n, s, e) for n, s, e, c in own]
        parts[t] += [(a[3], 1, min(a[0], b[0]), min(a[2], b[2]), max(a[1], b[1])) for a, b in zip(own, own[1:])]
        for c in {e[3] for e in own}:
            here = [e for e in own if e[3] == c]
            parts[t].append((c, 2, None, min(e[1] for e in here), max(e[2] for e in here)))
    best = {}
    for i, chrom, pos in points:
        for t, some in parts.items():
            for c, kind, n, s, e in some:
                if c == chrom and s <= pos < e:
                    best[i, t] = min(best.get((i, t), (9, 0)), (kind, n or 0))
    return {(i, t, ("exon", "intron", "transcript")[k], n or None) for (i, t), (k, n) in best.items()}


def test_parts_equal_trying_all(spark):
    rng = random.Random(8)
    exons = []
    for t in range(40):
        at = rng.randint(0, 3000)
        for n in range(1, rng.randint(2, 6)):
            exons.append((f"t{t}", f"chr{1 + t % 2}", n, at, at + rng.randint(1, 90)))
            at += rng.choice([-150, 60, 200])
    # Every tenth id stands in two points, and of those some lie in one transcript twice.
    points = [(i - (i % 10 == 9), f"chr{1 + rng.randint(0, 1)}", rng.randint(0, 4000)) for i in range(900)]
    p = spark.createDataFrame(points, "point_id long, l_chrom string, l_pos long")
    x = spark.createDataFrame(exons, "transcript_id string, chrom string, exon_number int, start_pos long, end_pos long")
    out = annotate.exon_or_intron(p, x)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(points, exons) and {g[2] for g in got} == {"exon", "intron"} | {"transcript"} & {g[2] for g in got}


def test_one_row_for_a_point_and_transcript_before_grouping(spark, monkeypatch):
    """The join gives a pair once, however many parts of the transcript hold the point."""
    seen = []
    meet = annotate.point_join

    def counted(points, rows):
        seen.append(meet(points, rows).count())
        return meet(points, rows)

    monkeypatch.setattr(annotate, "point_join", counted)
    p = spark.createDataFrame([(1, "chr1", 10)], "point_id long, l_chrom string, l_pos long")
    x = spark.createDataFrame([("t", "chr1", 1, 0, 20), ("t", "chr1", 2, 5, 30)], "transcript_id string, chrom string, exon_number int, start_pos long, end_pos long")
    assert [tuple(r) for r in annotate.exon_or_intron(p, x).collect()] == [(1, "t", "exon", 1)]
    assert seen == [1]


def test_query_equals_its_sql(spark):
    from genostrata.plans import catalogue
    from oracle import same

    same(spark, catalogue.QUERIES["exon_intron"], catalogue.ORACLES["exon_intron"], "/root/testdata/sf0.01")
