"""Allele-fraction statistics as columns."""

from __future__ import annotations

from math import log, log1p
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DEPTH = 20


def wilson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """struct(low, high): the score interval of k of n, within [0, 1]."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    centre = (k + z * z / 2) / (n + z * z)
    spread = z / (n + z * z) * F.sqrt(k * (n - k) / n + z * z / 4)
    return F.struct(F.greatest(F.lit(0.0), centre - spread).alias("low"), F.least(F.lit(1.0), centre + spread).alias("high"))


def _status(k: Column, n: Column, neutral: Column, implied: Column, min_depth: int) -> Column:
    return F.when(~neutral, "not_copy_neutral").when(n < min_depth, "depth_too_low").when(k == 0, "no_variant_reads").when(implied > 1.0, "vaf_exceeds_model").otherwise("determinable")


def doubled_fraction(k: Column, n: Column, neutral: Column, scale: Column, min_depth: int = MIN_DEPTH) -> Column:
    """struct(status, point, low, high): scale * k / n where it can be told, nulls elsewhere.

    Scale 2 gives the tumour fraction of a clonal variant, 2 / fraction its cancer cell fraction.
    """
    implied = k / n * scale
    status = _status(k, n, neutral, implied, min_depth)
    band = wilson(k, n)
    told = status == "determinable"
    return F.struct(status.alias("status"), F.when(told, implied).alias("point"), F.when(told, F.least(F.lit(1.0), band["low"] * scale)).alias("low"), F.when(told, F.least(F.lit(1.0), band["high"] * scale)).alias("high"))


def expected_vaf(fraction: Column, ccf: Column) -> Column:
    return fraction * ccf / 2


def copy_number_from_ratio(ratio: Column, fraction: Column) -> Column:
    """The tumour's copy number behind an observed ratio; null below the mixture's floor."""
    possible = (fraction > 0) & (fraction <= 1) & (ratio >= 1 - fraction)
    return F.when(possible, (2 * ratio - 2 * (1 - fraction)) / fraction)


def min_variant_reads(depths: DataFrame, error: float, alpha: float) -> DataFrame:
    """(depth, min_reads): the least k >= 1 with P(X >= k) <= alpha; depth + 1 if there is none.

    ``depths(depth int)``; worked out once for each distinct depth, in one walk down from
    the top: each chance follows from the one above it, as a logarithm.
    """
    distinct = depths.select("depth").where("depth > 0").distinct()
    n = F.col("depth")
    odds = log1p(-error) - log(error)

    def down(state: Column, k: Column) -> Column:
        tail = state["tail"] + F.exp(state["log_chance"])
        least = F.when(tail <= alpha, k).otherwise(state["least"])
        return F.struct((state["log_chance"] + F.ln(k / (n - k + 1)) + odds).alias("log_chance"), tail.alias("tail"), least.alias("least"))

    begin = F.struct((n * log(error)).alias("log_chance"), F.lit(0.0).alias("tail"), (n + 1).alias("least"))
    return distinct.select("depth", F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), begin, down)["least"].alias("min_reads"))


def _chance_of_fewer(reads: Column, log_ways: Column, depth: Column, fraction: Column) -> Column:
    """P(X < reads) of ``depth`` trials: the chance of reads - 1, and down from it by ratios."""
    top = log_ways + (reads - 1) * F.ln(fraction) + (depth - reads + 1) * F.log1p(-fraction)
    odds = (1 - fraction) / fraction

    def down(state: Column, k: Column) -> Column:
        chance = state["chance"] * k / (depth - k + 1) * odds
        return F.struct(chance.alias("chance"), (state["total"] + chance).alias("total"))

    begin = F.struct(F.exp(top).alias("chance"), F.exp(top).alias("total"))
    steps = F.when(reads > 1, F.sequence(reads - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, begin, down)["total"]


#: Halvings of the search for a fraction.
HALVINGS = 60


def min_detectable(reads: DataFrame, *, power: float = 0.95) -> DataFrame:
    """``reads(depth, min_reads)`` with min_vaf: the least fraction that gives so many reads with ``power``.

    Null if the depth has no such count. Searched by halving, once for each distinct depth.
    """
    distinct = reads.select("depth", "min_reads").distinct()
    n, k = F.col("depth"), F.col("min_reads")
    ways = F.aggregate(F.when(k > 1, F.sequence(F.lit(1), k - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln((n - i + 1) / i))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        enough = _chance_of_fewer(k, F.col("ways"), n, middle) <= 1 - power
        return F.struct(F.when(enough, state["low"]).otherwise(middle).alias("low"), F.when(enough, middle).otherwise(state["high"]).alias("high"))

    begin = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begin, halve)["high"]
    solved = distinct.where("min_reads <= depth").withColumn("ways", ways).select("depth", "min_reads", found.alias("min_vaf"))
    return reads.join(solved, ["depth", "min_reads"], "left")


def detectable_clone(min_vaf: Column, tumour_fraction: Column) -> Column:
    """The least cancer cell fraction that reaches ``min_vaf``; null if not even a clonal variant does."""
    share = F.when((tumour_fraction > 0) & (tumour_fraction <= 1), 2 * min_vaf / tumour_fraction)
    return F.when(share <= 1, share)


def jeffreys_variance(k: Column, n: Column) -> Column:
    """Variance of Beta(k + 1/2, n - k + 1/2)."""
    a, b = k + 0.5, n - k + 0.5
    return a * b / ((a + b) * (a + b) * (a + b + 1))
