"""Mixtures of two sources from read-level methylation calls."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genostrata.functions.evidence import first_reason
from genostrata.functions.stats import jeffreys_variance


def call_state(llr, motifs, threshold: float = 2.5):
    """M, U or A by the log-likelihood ratio against the threshold for each motif."""
    return F.when(llr >= threshold * motifs, "M").when(llr <= -threshold * motifs, "U").otherwise("A")


def deduplicated(reads: DataFrame) -> DataFrame:
    """One call for each read and marker: the one of the largest event_id."""
    last = Window.partitionBy("read_name", "marker_id").orderBy(F.desc("event_id"))
    return reads.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def marker_counts(reads: DataFrame) -> DataFrame:
    """(source, marker_id, m, u, a, beta): calls by state; beta is null without an informative call."""
    state = call_state(F.col("llr"), F.col("num_motifs"))
    rows = reads.withColumn("s", state)
    out = rows.groupBy("source", "marker_id").agg(*[F.count_if(F.col("s") == x).alias(x.lower()) for x in "MUA"])
    return out.withColumn("beta", F.round(F.try_divide(F.col("m"), F.col("m") + F.col("u")), 9))


def reference_markers(counts: DataFrame, min_calls: int, min_delta: float, most: int) -> DataFrame:
    """Markers that tell the sources apart: enough calls on both, the largest differences, by id."""
    a = counts.where("source = 'A'").select("marker_id", F.col("m").alias("ma"), F.col("u").alias("ua"))
    b = counts.where("source = 'B'").select("marker_id", F.col("m").alias("mb"), F.col("u").alias("ub"))
    both = a.join(b, "marker_id").where(f"ma + ua >= {min_calls} AND mb + ub >= {min_calls}")
    both = both.withColumn("delta", F.col("ma") / (F.col("ma") + F.col("ua")) - F.col("mb") / (F.col("mb") + F.col("ub")))
    order = [F.desc(F.abs(F.round("delta", 12))), "marker_id"]
    return both.where(F.abs("delta") >= min_delta - 1e-12).orderBy(*order).limit(most)


def point_estimate(markers: DataFrame, observed: DataFrame) -> DataFrame:
    """(level, n_markers, fraction, clamped, rmse): weighted least squares of the share of source A.

    Weights are the inverse of the summed posterior variances of both references and the
    mixture; a marker without a call in the level is left out.
    """
    seen = observed.select("level", "marker_id", F.col("m").alias("mo"), F.col("u").alias("uo")).where("m + u > 0")
    x = seen.join(markers, "marker_id")
    fa, fb, fo = (F.col(f"m{s}") / (F.col(f"m{s}") + F.col(f"u{s}")) for s in "abo")
    variance = sum((jeffreys_variance(F.col(f"m{s}"), F.col(f"m{s}") + F.col(f"u{s}")) for s in "abo"), F.lit(0.0))
    x = x.select("level", (fa - fb).alias("d"), (fo - fb).alias("r"), (1 / F.greatest(variance, F.lit(1e-12))).alias("w"))
    sums = x.groupBy("level").agg(F.count(F.lit(1)).alias("n_markers"), F.sum(F.col("w") * F.col("d") * F.col("r")).alias("top"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("bottom"))
    fit = sums.withColumn("raw", F.try_divide("top", "bottom"))
    residual = x.join(fit.select("level", "raw"), "level").groupBy("level").agg(F.sum(F.col("w") * F.pow(F.col("r") - F.col("raw") * F.col("d"), F.lit(2.0))).alias("rss"))
    out = fit.join(residual, "level", "left")
    rmse = F.sqrt(F.col("rss") / F.greatest(F.col("n_markers") - 1, F.lit(1)))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw")))
    return out.select("level", "n_markers", F.round("raw", 9).alias("raw"), F.round(clamped, 9).alias("fraction"), F.round(rmse, 9).alias("rmse"))


def interval_draws(markers: DataFrame, observed: DataFrame, draws: int = 500, seed: int = 11, confidence: float = 0.95) -> DataFrame:
    """(level, low, high, n_draws): the interval of the fraction from draws around the fitted mixture.

    At the fitted fraction every marker has one distribution over the states methylated,
    unmethylated and ambiguous, mixed from the two references, whose rates stay fixed. A
    draw takes the marker's rates from a Dirichlet of the mixture's number of calls, states
    of no probability keeping none, and fits the fraction again. ``markers`` may have aa and
    ab, ``observed`` a (ambiguous calls; none where missing). Each level is one group of at
    most as many rows as there are markers; the generator is seeded by the level, so
    results do not depend on partitioning.
    """
    zero = lambda df, c: F.col(c) if c in df.columns else F.lit(0).cast("long")
    x = observed.where("m + u > 0").select("level", "marker_id", F.col("m").alias("mo"), F.col("u").alias("uo"), zero(observed, "a").alias("ao"))
    rows = x.join(markers.select("marker_id", "ma", "ua", zero(markers, "aa").alias("aa"), "mb", "ub", zero(markers, "ab").alias("ab")), "marker_id")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        level = group["level"].iloc[0]
        group = group.sort_values("marker_id")
        rng = np.random.default_rng([seed, zlib.crc32(str(level).encode())])
        rates = {s: group[[f"m{s}", f"u{s}", f"a{s}"]].to_numpy(float) for s in "abo"}
        beta = {s: c[:, 0] / (c[:, 0] + c[:, 1]) for s, c in rates.items()}
        k = {s: (c[:, 0] + 0.5, c[:, 1] + 0.5) for s, c in rates.items()}
        variance = sum(p * q / ((p + q) ** 2 * (p + q + 1)) for p, q in k.values())
        d, w = beta["a"] - beta["b"], 1 / np.maximum(variance, 1e-12)
        bottom = (w * d * d).sum()
        found = np.empty(0)
        if bottom > 0:
            fraction = min(1.0, max(0.0, (w * d * (beta["o"] - beta["b"])).sum() / bottom))
            share = {s: c / c.sum(axis=1, keepdims=True) for s, c in rates.items()}
            mixed = fraction * share["a"] + (1 - fraction) * share["b"]
            g = rng.standard_gamma(np.broadcast_to(mixed * rates["o"].sum(axis=1, keepdims=True), (draws, *mixed.shape)))
            called = g[..., 0] + g[..., 1]
            again = np.divide(g[..., 0], called, out=np.full(called.shape, np.nan), where=called > 0)
            seen = ~np.isnan(again)
            top = np.where(seen, w * d * (np.nan_to_num(again) - beta["b"]), 0).sum(axis=1)
            under = np.where(seen, w * d * d, 0).sum(axis=1)
            found = np.clip(top[under > 0] / under[under > 0], 0, 1)
        tail = (1 - confidence) / 2
        ends = np.quantile(found, [tail, 1 - tail]) if len(found) else [None, None]
        return pd.DataFrame([(level, ends[0], ends[1], len(found))], columns=["level", "low", "high", "n_draws"])

    return rows.groupBy("level").applyInPandas(draw, "level string, low double, high double, n_draws long")


def level_gates(estimates: DataFrame, n_reference: DataFrame, intervals: DataFrame | None = None, *, min_markers: int = 20, max_extrapolation: float = 0.1, max_rmse: float = 3.0, draws: int = 500, min_drawn: float = 0.8, max_width: float = 0.5) -> DataFrame:
    """(level, status, reason) of ``estimates(level, n_markers, raw, rmse)``: the first gate that fails is named.

    In order: reference markers (``n_reference(n)``, one row), markers used, extrapolation of
    the raw fraction, fit, and with ``intervals(level, low, high, n_draws)`` the number of
    draws that gave an estimate and the width of the interval.
    """
    rows = estimates.join(F.broadcast(n_reference.select(F.col("n").alias("n_reference"))), F.lit(True))
    raw = F.col("raw")
    gates = [
        ("few_reference_markers", F.col("n_reference") < min_markers),
        ("few_markers_used", (F.col("n_markers") < min_markers) | raw.isNull()),
        ("extrapolated", (raw < -max_extrapolation) | (raw > 1 + max_extrapolation)),
        ("poor_fit", F.col("rmse") > max_rmse),
    ]
    if intervals is not None:
        rows = rows.join(intervals, "level", "left")
        gates.append(("few_draws", F.coalesce(F.col("n_draws"), F.lit(0)) < math.ceil(draws * min_drawn)))
        gates.append(("wide_interval", F.col("high") - F.col("low") > max_width))
    reason = first_reason(gates)
    return rows.select("level", F.when(reason.isNull(), "COMPLETED").otherwise("NO_CALL").alias("status"), reason.alias("reason"))


def recovery(estimates: DataFrame, expected: DataFrame) -> DataFrame:
    """bias, mae, rmse over completed levels; the no-call rate over all expected ones."""
    both = expected.join(estimates, "level", "left").withColumn("error", F.col("fraction") - F.col("truth"))
    return both.agg(F.count(F.lit(1)).alias("expected"), F.count("fraction").alias("completed"), F.round(F.avg("error"), 9).alias("bias"), F.round(F.avg(F.abs("error")), 9).alias("mae"), F.round(F.sqrt(F.avg(F.col("error") * F.col("error"))), 9).alias("rmse"), F.round(1 - F.count("fraction") / F.count(F.lit(1)), 9).alias("no_call_rate"))
