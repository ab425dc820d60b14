"""Clusters from the heads' side: the same as call by call, for windows of any size."""

import random

import pandas as pd
import pytest

from genostrata.operators import consensus


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("at_once", [0, 12, 10**6])
def test_heads_take_what_calls_would_join(monkeypatch, within, at_once):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        s, kind = rng.randrange(3000), rng.choice(["deletion", "insertion", "inversion", None])
        n = rng.choice([0, 1, 60, 90, 200, 400])
        length = rng.choice([float(n), float(n), float("nan"), -5.0])
        rows.append((f"e{i:05d}", kind, rng.choice(["a", "b", None]), "chr1", s, s + n, "", -1, -1, rng.choice(["", "", "+-", "-+", "+-,-+"]), length, s // 1000, rng.random() < 0.05))
    table = pd.DataFrame(rows, columns=["event_id", "event_type", "caller", "chrom", "start_pos", "end_pos", "chrom2", "start2", "end2", "strands", "length", "tile", "given"])
    policy = consensus.Policy(max_distance=150, merge_within_caller=within)
    monkeypatch.setattr(consensus, "AT_ONCE", at_once)
    one = consensus._one_by_one(table.sort_values(consensus._TILE + consensus._ORDER), policy)
    got = consensus.greedy(table, policy)
    plain = lambda t: sorted(map(tuple, t[["event_id", "head", "distance", "tile"]].to_numpy().tolist()))
    assert plain(got) == plain(one) and 50 < got["head"].nunique() < len(got)


def test_dense_windows_call_no_pair_of_calls(monkeypatch):
    def refuse(*_):
        raise AssertionError("one call against one head")

    monkeypatch.setattr(consensus, "matches", refuse)
    table = pd.DataFrame([(f"e{i:05d}", "deletion", "a", "chr1", i // 50, i // 50 + 900, "", -1, -1, "", 900.0, 0, False) for i in range(3000)], columns=["event_id", "event_type", "caller", "chrom", "start_pos", "end_pos", "chrom2", "start2", "end2", "strands", "length", "tile", "given"])
    got = consensus.greedy(table[:-12], consensus.Policy())
    assert got["head"].nunique() == 1 and got["distance"].max() == 59


def test_rounds_leave_no_tables_behind(spark, monkeypatch):
    from genostrata.operators import scratch

    held, write = [], scratch.Tables.written
    monkeypatch.setattr(scratch.Tables, "written", lambda self, df: (held.append(len(self.paths)), write(self, df))[1])
    calls = [(f"e{i:04d}", "deletion", "chr1", 60 * i, 60 * i + 2000 + i % 13) for i in range(100)]
    df = spark.createDataFrame(calls, "event_id string, event_type string, chrom string, start_pos long, end_pos long")
    got = consensus.cluster_calls(df, tile=600).collect()
    assert len(got) == 100 and len(held) > 8 and max(held) <= 5
