"""Evidence arrays and scores of structural-variant events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScorePolicy:
    """Weights and floors of the technical priority score."""

    high: int = 8
    moderate: int = 5
    support: tuple[tuple[int, int], ...] = ((20, 4), (10, 2), (5, 1))
    vaf: tuple[tuple[float, int], ...] = ((0.10, 2), (0.05, 1))
    consensus: int = 4
    single: int = 1
    precise: int = 1
    not_pass: int = -3
    observed: int = 1
    not_observed: int = -1
    context: int = -1
    most_context: int = 3
    known: int = 2
    balanced: int = 1


def _ladder(value: Column, steps: tuple[tuple[float, int], ...]) -> Column:
    out = F.lit(0)
    for floor, weight in reversed(steps):
        out = F.when(value >= floor, weight).otherwise(out)
    return out


def max_support(evidence: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(evidence, lambda e: F.coalesce(e["support_reads"], F.lit(0)))), F.lit(0))


def best_vaf(evidence: Column) -> Column:
    """The largest known allele fraction, null if none is known."""
    return F.array_max(F.transform(evidence, lambda e: e["vaf"]))


def callers(evidence: Column) -> Column:
    names = F.transform(evidence, lambda e: F.lower(F.trim(e["caller"])))
    return F.array_sort(F.array_distinct(F.filter(names, lambda c: c != "")))


def clean(evidence: Column) -> Column:
    """No filter but PASS on any piece of evidence."""
    return F.forall(evidence, lambda e: F.coalesce(e["filter"], F.lit("PASS")) == "PASS")


def artifact_flags(flags: Column) -> Column:
    """Distinct technical flags other than generic mappability."""
    return F.array_distinct(F.filter(flags, lambda f: F.substring_index(f, ":", -1) != "mappability"))


def score(*, support: Column, n_callers: Column, vaf: Column, is_precise: Column, is_clean: Column, observability: Column, flags: Column, known: Column, event_type: Column, policy: ScorePolicy = ScorePolicy()) -> Column:
    """The additive score; unknown allele fractions and observability add nothing."""
    p = policy
    penalty = F.least(F.lit(p.most_context), F.lit(abs(p.context)) * F.size(artifact_flags(flags)))
    balanced = event_type.isin("translocation", "inversion") & (support >= p.support[1][0])
    return (
        F.when(n_callers >= 2, p.consensus).when(n_callers == 1, p.single).otherwise(0)
        + _ladder(support, p.support)
        + F.when(is_precise, p.precise).otherwise(0)
        + F.coalesce(_ladder(vaf, p.vaf), F.lit(0))
        + F.when(is_clean, 0).otherwise(p.not_pass)
        + F.when(observability == "observed_adequately", p.observed).when(observability.isin("insufficient_coverage", "outside_target"), p.not_observed).otherwise(0)
        - penalty
        + F.when(known, p.known).otherwise(0)
        + F.when(balanced, p.balanced).otherwise(0)
    )


def tier(value: Column, policy: ScorePolicy = ScorePolicy()) -> Column:
    return F.when(value >= policy.high, "high").when(value >= policy.moderate, "moderate").otherwise("low")


def tier_order(name: Column) -> Column:
    return F.when(name == "high", 0).when(name == "moderate", 1).otherwise(2)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The reason of the first rule that fails a row, null if none does."""
    return F.coalesce(*[F.when(failed, reason) for reason, failed in rules])


def gene_pair_label(known: Column, genes: Column) -> Column:
    """The known pattern, else the first two genes as ``A::B``, else ``unannotated``."""
    return F.coalesce(known, F.when(F.size(genes) >= 2, F.concat_ws("::", F.get(genes, F.lit(0)), F.get(genes, F.lit(1)))), F.get(genes, F.lit(0)), F.lit("unannotated"))
