import pytest
from fixture_paths import SF, TINY
from oracle import same

import __spark_entry__ as entry
from genostrata.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], TINY)


@pytest.mark.parametrize("name", ["overlap_targets_by_type", "nearest_target", "benchmark_prf", "reference_markers"])
def test_query_equals_sql_on_more_rows(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mixture_draws_cover_their_estimates(spark):
    draws = {r["level"]: r for r in catalogue.QUERIES["mixture_draws"](spark, SF).collect()}
    points = {r["level"]: r["fraction"] for r in catalogue.QUERIES["mixture_point_estimate"](spark, SF).collect()}
    assert draws.keys() == points.keys()
    assert all(0 <= d["low"] <= d["high"] <= 1 for d in draws.values())
