"""Targets of the mixture are held as given, over many times the length of any rounded period."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from genostrata.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 1 / 3, **{f"s{i}": (1 + i) ** 0.5 / 97 for i in range(19)}}, {"tiny": 1e-5, "b": 0.7, "c": 0.29999}])
def test_deviation_from_the_targets(weights):
    total = sum(Fraction(w) for w in weights.values())
    share = {k: Fraction(w) / total for k, w in weights.items()}
    n = 20_000
    slots = mixing.block_slots(mixing.exact_units(weights), {k: int(s * n) + 2 for k, s in share.items()})
    for k, places in slots.items():
        for b, t in enumerate(places):
            if t >= n:
                break
            assert abs(b + 1 - share[k] * (t + 1)) < 1 and abs(b - share[k] * t) < 1


def test_equal_targets_stay_equal(spark):
    df = spark.range(15_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    got = mixing.mix(df, weights={"0": 1, "1": 1, "2": 1}, block_docs=1)
    firsts = got.groupBy("source").agg(F.max(F.abs(F.col("block") - F.expr("slot div 3"))).alias("off")).collect()
    assert len(firsts) == 3 and all(r["off"] == 0 for r in firsts)


def test_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 700).cast("string").alias("source"))
    got = mixing.mix(df, block_docs=2).select("slot", "in_block").collect()
    assert len(got) == len(set(got)) == 3000


def test_plan_as_a_table(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"))
    want = sorted(mixing.mix(df, block_docs=1).collect())
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 2)
    assert sorted(mixing.mix(df, block_docs=1).collect()) == want
