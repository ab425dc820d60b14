"""Clusters of calls of which many are equal: the same as one by one, with each kind searched once."""

import random

import pytest

from genostrata.operators import consensus

PAIR = "event_id string, event_type string, caller string, chrom string, start_pos long, end_pos long, chrom2 string, start2 long, end2 long, orientations array<string>"


@pytest.mark.parametrize("within", [True, False])
def test_equal_calls_are_searched_once(spark, monkeypatch, within):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        s, s2 = rng.randrange(6) * 40, rng.randrange(6) * 40
        kind = rng.choice(["translocation", "translocation", "deletion", "insertion"])
        two = ("chr2", s2, s2 + 1) if kind == "translocation" and rng.random() < 0.9 else (None, None, None)
        rows.append((f"e{rng.randrange(10**6)}-{i}", kind, rng.choice(["a", "b"]), "chr1", s, s + rng.choice([0, 1, 30]), *two, rng.choice([[], ["+-"], ["-+"]])))
    calls = spark.createDataFrame(rows, PAIR)
    policy = consensus.Policy(max_distance=50, merge_within_caller=within)
    # One head after another, as they were opened: what a call is held against without any index.
    want = {}
    canon = consensus.canonical(calls).toPandas().sort_values(["event_type", "chrom", "chrom2", *consensus._ORDER])
    heads, here = [], None
    for r in canon.itertuples():
        if (place := (r.event_type, r.chrom, r.chrom2)) != here:
            here, heads = place, []
        x = (r.start_pos, r.end_pos, r.start2, r.end2, frozenset(filter(None, r.strands.split(","))), r.length, r.caller)
        heads = [h for h in heads if x[0] - h[1][0] <= 50]
        hit = next(((h, g) for h, y in heads if (g := consensus.matches(y, x, r.event_type, policy)) is not None), None)
        want[r.event_id] = hit or (r.event_id, 0)
        if hit is None:
            heads.append((r.event_id, x))
    for repeated in (True, False):
        got = consensus.cluster_calls(calls, policy, tile=400, repeated=repeated).collect()
        assert {r["event_id"]: (r["head"], r["distance"]) for r in got} == want and len(got) == len(rows)
    kinds, same, _ = consensus._alike(consensus.canonical(calls).selectExpr("*", "0L AS tile"), policy)
    assert kinds.count() < len(rows) * 0.8
