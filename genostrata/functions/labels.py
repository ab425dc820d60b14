"""Labels of events and runs: what a reviewer reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def release_state(reportable: Column) -> Column:
    """An event that is not reportable needs a benchmark; that is no verdict on the event."""
    return F.when(reportable, "REPORTABLE").otherwise("BENCHMARK_REQUIRED")


def fusion_assessment(status: Column, has_evidence: Column) -> Column:
    return F.when(status == "validated", "VALIDATED").when(status == "supported", "SUPPORTED").when(status == "candidate", "KNOWLEDGE_MATCH_CANDIDATE").when(has_evidence, "BREAKPOINT_EVIDENCE").otherwise("NOT_APPLICABLE")


def review_priority(known: Column, has_fusion_evidence: Column, confidence: Column) -> Column:
    sure = F.coalesce(confidence.isin("high", "moderate"), F.lit(False))
    return F.when(known, "HEMATOLOGY_REVIEW").when(has_fusion_evidence & sure, "FUSION_REVIEW").when(sure, "TECHNICAL_REVIEW").otherwise("BACKGROUND")


def pathology_label(entries: Column) -> Column:
    """``name (id); ...`` of an array of structs (name, id); null without any."""
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit(" ("), e["id"], F.lit(")"))), "; ")
    return F.nullif(text, F.lit(""))


def cellularity_tier(value: Column, critical: float, review: float) -> Column:
    return F.when(value < critical, "critical").when(value < review, "review").when(value.isNotNull(), "unflagged")


def call_type(call: Column) -> Column:
    """deletion or duplication from a segment caller's word; null for neutral and unknown ones."""
    word = F.upper(call)
    return F.when(word.isin("HOMD", "HETD", "LOSS", "DEL"), "deletion").when(word.isin("GAIN", "AMP", "HLAMP", "DUP"), "duplication")


def shown(value: Column) -> Column:
    """Text of a cell, ``n/a`` for null."""
    return F.coalesce(value.cast("string"), F.lit("n/a"))


def first_known(values: Column) -> Column:
    """The first value of an array that is not null; null if there is none."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def band(value: Column, edges: tuple[float, ...]) -> Column:
    """``<a``, ``[a,b)`` ... ``>=z`` by rising edges; null stays null."""
    out = F.when(value < edges[0], f"<{edges[0]}")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when(value < b, f"[{a},{b})")
    return out.when(value.isNotNull(), f">={edges[-1]}")


def event_class(event_type: Column, copy_number: Column) -> Column:
    """cnv for a deletion or duplication of known copy number, sv for everything else."""
    return F.when(event_type.isin("deletion", "duplication") & copy_number.isNotNull(), "cnv").otherwise("sv")


def gates(values: dict[str, Column | None], floors: dict[str, float], warnings: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(failed gates as sorted text, verdict FAIL, WARN or PASS): a metric below its floor fails.

    A metric that was not measured (missing or null) fails too: not measured is not passed.
    One above its floor but below the floor of ``warnings`` warns.
    """
    value = lambda k: F.lit(None).cast("double") if values.get(k) is None else values[k]
    failed = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(value(k) < v, F.lit(True)), k) for k, v in floors.items()])))
    warned = F.lit(False)
    for k, v in (warnings or {}).items():
        warned |= F.coalesce(value(k) < v, F.lit(False))
    return F.array_join(failed, ","), F.when(F.size(failed) > 0, "FAIL").when(warned, "WARN").otherwise("PASS")


def small_variant_reason(*, passed: Column, depth: Column, reads: Column, min_reads: Column, min_depth: int = 30, least: int = 4) -> Column:
    """The first rule a small variant breaks, null if it is usable; ``min_reads`` is what its depth can resolve."""
    rules = [("not_pass", ~passed), ("low_depth", depth < min_depth), ("few_variant_reads", reads < least), ("unresolvable_depth", min_reads > depth), ("below_detection_floor", reads < min_reads)]
    return F.coalesce(*[F.when(bad, name) for name, bad in rules])
