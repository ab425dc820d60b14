"""Running values and the clustering that rests on them, against plain loops."""

import random

from genostrata.operators import consensus
from genostrata.operators.running import with_running


def test_running_values_over_pieces(spark):
    rng = random.Random(8)
    rows = [(f"chr{rng.randint(1, 2)}", rng.randint(0, 6_000_000), i, rng.choice([None, rng.randint(0, 99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "chrom string, pos long, id long, v int")
    for how in ("max", "last"):
        got = {r["id"]: r["x"] for r in with_running(df, ["chrom"], "pos", ["pos", "id"], "v", "x", how, span=500_000).collect()}
        seen = {}
        for c, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            assert got[i] == seen.get(c)
            if v is not None:
                seen[c] = max(v, seen.get(c, v)) if how == "max" else v
        assert len(got) == 300


def test_clusters_equal_one_greedy_pass(spark):
    rng = random.Random(6)
    calls = []
    for i in range(600):
        start = rng.choice([rng.randint(0, 30_000), rng.randint(999_000, 1_001_500), rng.randint(0, 4_000_000)])
        calls.append((f"e{i:04d}", f"chr{rng.randint(1, 2)}", rng.choice(["deletion", "insertion"]), start, start + rng.randint(300, 1800)))
    want, heads = {}, []
    for e, c, t, s, x in sorted(calls, key=lambda r: (r[2], r[1], r[3], r[4], r[0])):
        for h, hc, ht, hs, hx in heads:
            if (hc, ht) != (c, t) or max(abs(hs - s), abs(hx - x)) > 500 or abs((hx - hs) - (x - s)) / max(hx - hs, x - s) > 0.35:
                continue
            shared = max(0, min(hx, x) - max(hs, s))
            if t == "insertion" or min(shared / (hx - hs), shared / (x - s)) >= 0.5:
                want[e] = h
                break
        else:
            heads.append((e, c, t, s, x))
            want[e] = e
    df = spark.createDataFrame(calls, "event_id string, chrom string, event_type string, start_pos long, end_pos long")
    assert {r["event_id"]: r["head"] for r in consensus.cluster_calls(df).collect()} == want
