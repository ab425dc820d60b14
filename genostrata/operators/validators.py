"""Report contracts as queries: each returns what breaks a rule, as (key, rule) rows.

A report is checked by working its numbers out again from its rows; what agrees returns
nothing. Unknown never passes for equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE = 1e-9


def close(a: Column, b: Column, tolerance: float = RELATIVE) -> Column:
    """Equal within a relative tolerance; null is close to null only."""
    return F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), a.isNull() & b.isNull())


def broken(rows: DataFrame, key: str | Column, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that does not hold; a rule that cannot be told is broken."""
    key = F.col(key) if isinstance(key, str) else key
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return rows.select(key.cast("string").alias("key"), F.explode(names).alias("rule"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """(key, rule) of values of ``columns`` that stand in more than one row."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key"), F.lit(rule).alias("rule"))


def missing_from(rows: DataFrame, other: DataFrame, key: str, rule: str) -> DataFrame:
    """(key, rule) of keys of ``rows`` that ``other`` does not have."""
    return rows.where(F.col(key).isNotNull()).join(other.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"))


def thresholds(wide: DataFrame, key: str, depths: list[int]) -> DataFrame:
    """Bases at a deeper threshold never exceed those at a shallower one, and fractions are bases / length.

    ``wide`` has length, ``<depth>X`` bases and ``<depth>X_fraction``.
    """
    falling = [F.col(f"{b}X") <= F.col(f"{a}X") for a, b in zip(depths, depths[1:], strict=False)]
    shares = [close(F.col(f"{d}X_fraction"), F.col(f"{d}X") / F.col("length")) for d in depths]
    within = F.col(f"{depths[0]}X") <= F.col("length")
    return broken(wide, key, {"bases_rise_with_depth": reduce(lambda x, y: x & y, falling, within), "fraction_is_not_bases_by_length": reduce(lambda x, y: x & y, shares)})


def summary_differs(report: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """(key, rule) where a column of ``report`` is not what was worked out again, or a row lacks its like."""
    names = [c for c in report.columns if c != key]
    a, b = report.select(F.col(key).alias("ka"), F.struct(*names).alias("a")), again.select(F.col(key).alias("kb"), F.struct(*names).alias("b"))
    both = a.join(b, F.col("ka").eqNullSafe(F.col("kb")), "full")

    def same(c: str) -> Column:
        x, y = F.col("a")[c], F.col("b")[c]
        return close(x, y) if report.schema[c].dataType.typeName() in ("double", "float") else x.eqNullSafe(y)

    lone = F.col("a").isNotNull() & F.col("b").isNotNull()
    return broken(both, F.coalesce("ka", "kb"), {"row_without_like": lone} | {f"{c}_differs": ~lone | same(c) for c in names})


def foreign_sidecars(sidecars: DataFrame, expected: DataFrame) -> DataFrame:
    """Sidecars (artifact, sample, build, digest) of another sample or build, and conflicting repeats."""
    rows = sidecars.join(expected.select(F.col("sample").alias("s"), F.col("build").alias("b")), F.col("sample") == F.col("s"), "left")
    clash = sidecars.groupBy("artifact").agg(F.count_distinct("digest").alias("n")).where("n > 1").select(F.col("artifact").cast("string").alias("key"), F.lit("conflicting_repeats").alias("rule"))
    return together(broken(rows, "artifact", {"foreign_sample": F.col("s").isNotNull(), "foreign_build": F.col("s").isNull() | (F.col("build") == F.col("b"))}), clash)


def panel_facts(targets: DataFrame) -> DataFrame:
    """One row (n, n_labels, digest) of a panel (chrom, start_pos, end_pos, label): what its lock holds.

    The digest is the sum of 48-bit heads of SHA-256 row hashes, so order does not matter.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "label"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return targets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def panel_lock(targets: DataFrame, *, n: int, n_labels: int, digest: str, role: str, declared: str, name: str = "panel") -> DataFrame:
    """A panel of (chrom, start_pos, end_pos, label) against its lock; one row a broken rule, none if it holds."""
    got = panel_facts(targets)
    return broken(got, F.lit(name), {"row_count": F.col("n") == n, "label_count": F.col("n_labels") == n_labels, "content": F.col("digest") == digest, "role": F.lit(role == declared)})


def region_counts(regions: DataFrame, key: str) -> DataFrame:
    """Modified + canonical + other = valid; the fraction is null exactly where no site qualifies, else modified / valid."""
    whole = F.col("modified") + F.col("canonical") + F.col("other") == F.col("valid")
    return broken(regions, key, {"counts_do_not_add_up": whole, "fraction_without_site": (F.col("fraction").isNull()) == (F.col("n_sites") == 0), "fraction_differs": (F.col("n_sites") == 0) | close(F.col("fraction"), F.try_divide(F.col("modified").cast("double"), F.col("valid")))})


def haplotype_difference(rows: DataFrame, key: str) -> DataFrame:
    """A difference of h1 and h2 exactly where both are assessable, and equal to h1 - h2."""
    both = F.col("h1").isNotNull() & F.col("h2").isNotNull()
    return broken(rows, key, {"difference_without_both": F.col("difference").isNull() | both, "difference_missing": ~both | F.col("difference").isNotNull(), "difference_differs": F.col("difference").isNull() | close(F.col("difference"), F.col("h1") - F.col("h2"))})


def registered_levels(levels: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Levels (key, seed, n) against the registered grid: none missing, none extra, seeds distinct and as registered."""
    seeds = levels.join(grid.select(F.col(key).alias("k"), F.col("seed").alias("s")), F.col(key) == F.col("k"))
    return together(missing_from(grid, levels, key, "level_missing"), missing_from(levels, grid, key, "level_not_registered"), repeated(levels, ["seed"], "seed_used_twice"), broken(seeds, key, {"seed_differs": F.col("seed") == F.col("s")}))


def grid_coherence(grid: DataFrame) -> DataFrame:
    """Fractions (level, fraction, total) lie in [0, 1], are distinct, include 0 and 1, and each is a whole number of reads."""
    ends = grid.agg(F.min("fraction").alias("lo"), F.max("fraction").alias("hi"))
    reads = F.col("total") * F.col("fraction")
    return together(broken(grid, "level", {"fraction_out_of_range": F.col("fraction").between(0, 1), "budget_cannot_show_fraction": F.abs(reads - F.round(reads)) < 1e-6}), repeated(grid, ["fraction"], "fraction_repeated"), broken(ends, F.lit("grid"), {"no_zero": F.col("lo") == 0, "no_one": F.col("hi") == 1}))


def evidence_manifest(evidence: DataFrame, artifacts: DataFrame, events: DataFrame, identity: list[str]) -> DataFrame:
    """Evidence (id, address, artifact, identity ...) of events (id, sources array, identity ...).

    Ids and addresses are unique, every artifact is there and used, every source exists, and
    an event's identity columns equal those of its sources (null equals null).
    """
    sources = events.select(F.col("id").alias("event"), F.explode("sources").alias("id"), *[F.col(c).alias(f"e_{c}") for c in identity])
    met = sources.join(evidence.select("id", *identity), "id")
    return together(
        repeated(evidence, ["id"], "id_repeated"), repeated(evidence, ["address"], "address_repeated"),
        missing_from(evidence, artifacts, "artifact", "dangling_artifact"), missing_from(artifacts, evidence, "artifact", "orphan_artifact"),
        missing_from(sources, evidence, "id", "source_missing"),
        broken(met, "event", {f"{c}_differs": F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in identity}),
    )


def event_contract(events: DataFrame) -> DataFrame:
    """Paired types have a second locus and others none, loci are not empty, whole-chromosome events start at 0 when confirmed."""
    paired = F.col("event_type") == "translocation"
    whole = F.col("event_type").isin("chromosome_gain", "chromosome_loss")
    return broken(events, "event_id", {"second_locus": paired == F.col("chrom2").isNotNull(), "empty_locus": (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")), "confirmed_without_span": ~F.coalesce("span_confirmed", F.lit(False)) | (whole & (F.col("start_pos") == 0))})


def report_counts(reports: DataFrame, key: str) -> DataFrame:
    """raw = accepted + rejected, and the state follows from the number accepted."""
    state = F.when(F.col("accepted") > 0, "COMPLETED").otherwise("COMPLETED_EMPTY")
    return broken(reports, key, {"counts_do_not_add_up": F.col("raw") == F.col("accepted") + F.col("rejected"), "state_differs": F.col("state").isin("FAILED", "NOT_RUN") | (F.col("state") == state)})


def result_contract(modules: DataFrame) -> DataFrame:
    """Across the modules (run, module, state, n_events, reason) of a run.

    Only completed modules have events, one that did not complete says why, a module occurs
    once, and no run is without a quality module.
    """
    done = F.col("state") == "COMPLETED"
    runs = modules.groupBy("run").agg(F.bool_or(F.col("module") == "qc").alias("qc"))
    return together(broken(modules, F.concat_ws("|", "run", "module"), {"events_without_completion": done | (F.col("n_events") == 0), "no_reason": done | F.col("reason").isNotNull()}), repeated(modules, ["run", "module"], "module_repeated"), broken(runs, "run", {"no_quality_module": F.col("qc")}))


def dilution_consistency(plan: DataFrame, result: DataFrame, tolerance: float) -> DataFrame:
    """Results (level_id, tumour_reads, normal_reads) against the plan (level_id, fraction, total).

    Levels match one to one, reads add up to the total, and the fraction observed drifts by
    at most ``tolerance``.
    """
    met = result.join(plan, "level_id")
    reads = F.col("tumour_reads") + F.col("normal_reads")
    return together(missing_from(plan, result, "level_id", "level_missing"), missing_from(result, plan, "level_id", "level_not_planned"), repeated(result, ["level_id"], "level_repeated"), broken(met, "level_id", {"total_differs": reads == F.col("total"), "fraction_drifts": F.abs(F.try_divide(F.col("tumour_reads").cast("double"), reads) - F.col("fraction")) <= tolerance}))


def metric_report(metrics: DataFrame) -> DataFrame:
    """Metrics (metric, status, value, numerator, denominator, excluded: arrays of ids).

    Ids of the numerator lie in the denominator, excluded ids do not, a value is there
    exactly when EVALUABLE, and a metric stands once.
    """
    told = F.col("status") == "EVALUABLE"
    return together(broken(metrics, "metric", {"numerator_not_in_denominator": F.size(F.array_except("numerator", "denominator")) == 0, "excluded_in_denominator": F.size(F.array_intersect("excluded", "denominator")) == 0, "value_without_status": told == F.col("value").isNotNull()}), repeated(metrics, ["metric"], "metric_repeated"))


def run_report(stages: DataFrame) -> DataFrame:
    """Stages (run, stage, outcome, error, seconds) stand once; a failure has an error, nothing else has, and what ran has a time."""
    failed = F.col("outcome") == "FAILED"
    ran = F.col("outcome") != "NOT_RUN"
    return together(repeated(stages, ["run", "stage"], "stage_repeated"), broken(stages, F.concat_ws("|", "run", "stage"), {"error_without_failure": failed == F.col("error").isNotNull(), "time_without_run": ran == F.col("seconds").isNotNull(), "negative_time": F.coalesce(F.col("seconds") >= 0, F.lit(True))}))


def score_vectors(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Score vectors (key, scores array) of two runs agree in every unit, in the first place, and sum to 1."""
    both = left.select(key, F.col("scores").alias("a")).join(right.select(key, F.col("scores").alias("b")), key, "full")
    near = F.forall(F.zip_with("a", "b", lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda ok: ok)
    first = lambda c: F.array_position(c, F.array_max(c))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    sized = F.size("a") == F.size("b")
    return broken(both, key, {"lengths_differ": sized, "scores_differ": near, "first_place_differs": first(F.col("a")) == first(F.col("b")), "sum_is_not_one": (F.abs(total("a") - 1) <= 1e-6) & (F.abs(total("b") - 1) <= 1e-6)})


def concordance(rows: DataFrame) -> DataFrame:
    """One row with n, assessed, agreeing and share of (expected, top); null on either side is not assessed."""
    told = F.col("expected").isNotNull() & F.col("top").isNotNull()
    n, k = F.count_if(told), F.count_if(told & (F.col("expected") == F.col("top")))
    return rows.agg(F.count(F.lit(1)).alias("n"), n.alias("assessed"), k.alias("agreeing"), F.round(F.try_divide(k, n), 9).alias("share"))


def no_overlap(rows: DataFrame, by: str) -> DataFrame:
    """(key, rule) of intervals that begin before the one before them ends."""
    before = F.lag("end_pos").over(Window.partitionBy(by).orderBy("start_pos", "end_pos"))
    return rows.withColumn("before", before).where("start_pos < before").select(F.concat_ws(":", by, F.col("start_pos").cast("string")).alias("key"), F.lit("overlaps_previous").alias("rule"))


def state_conflicts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows disagree in one of ``columns``: one rule for each column."""
    per = rows.groupBy(key).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(c) for c in columns])
    return broken(per, key, {f"{c}_conflict": F.col(c) <= 1 for c in columns})
