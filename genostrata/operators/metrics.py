"""Validation metrics with their members, decisions over strata, source summaries and run states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lane_id(columns: list[str]) -> Column:
    """``lane-`` and 24 digits of the SHA-256 of the named columns as JSON in order of name."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.array(F.col(c).cast("string"))), F.lit("[null]"))) for c in sorted(columns)]
    return F.concat(F.lit("lane-"), F.substring(F.sha2(F.concat_ws(",", *parts), 256), 1, 24))


def assigned_lanes(records: DataFrame, key: list[str]) -> DataFrame:
    """(lane, n_events, n_primary, run_summaries, complete) of records (kind, primary, key columns).

    A lane is complete with exactly one run summary; only primary events count as its calls.
    """
    event = F.col("kind") == "event"
    per = records.groupBy(lane_id(key).alias("lane")).agg(F.count_if(event).alias("n_events"), F.count_if(event & F.coalesce("primary", F.lit(False))).alias("n_primary"), F.count_if(F.col("kind") == "run_summary").alias("run_summaries"))
    return per.withColumn("complete", F.col("run_summaries") == 1)


def membership(rows: DataFrame, by: str, identifier: str, numerator: Column, denominator: Column) -> DataFrame:
    """(by, numerator, denominator, excluded, value): sorted distinct ids and the share they make.

    Ids outside the denominator are excluded; without a denominator there is no value.
    """
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(identifier))))
    out = rows.groupBy(by).agg(ids(numerator & denominator).alias("numerator"), ids(denominator).alias("denominator"), ids(~denominator).alias("excluded"))
    return out.withColumn("value", F.round(F.try_divide(F.size("numerator"), F.size("denominator")), 9))


def assembled(families: dict[str, DataFrame], source: str) -> DataFrame:
    """One report of metric families (metric, value): family, metric, value, place, seal; in order of family and metric.

    The seal of a row is the SHA-256 of source, family, metric and value (nine digits).
    """
    out = None
    for name in sorted(families):
        rows = families[name].select(F.lit(name).alias("family"), F.col("metric").cast("string").alias("metric"), F.round(F.col("value").cast("double"), 9).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    shown = F.coalesce(F.format_string("%.9f", F.col("value")), F.lit("null"))
    # Places are counted within a family, and families before it are added: no window over all rows.
    sizes = out.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("family", (F.sum("n").over(Window.orderBy("family").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("family").orderBy("metric")) + F.col("before")
    return out.join(F.broadcast(before), "family").select("family", "metric", "value", place.alias("place"), F.sha2(F.concat_ws("|", F.lit(source), "family", "metric", shown), 256).alias("seal"))


def validation_decision(strata: DataFrame, by: str) -> DataFrame:
    """(by, decision): NO_CALL with any reason against eligibility or nothing completed, FAIL if a stratum did not pass, else PASS.

    ``strata(by, ineligible, completed, verdict)``.
    """
    decision = F.when(F.bool_or("ineligible") | (F.sum("completed") == 0), "NO_CALL").when(F.bool_or(F.coalesce(F.col("verdict") != "PASS", F.lit(True))), "FAIL").otherwise("PASS")
    return strata.groupBy(by).agg(decision.alias("decision"))


def recovery_assessment(metrics: DataFrame, *, max_mae: float, max_rmse: float, max_no_call: float, min_levels: int) -> DataFrame:
    """``metrics(completed, mae, rmse, no_call_rate, ...)`` with verdict PASS, FAIL or NOT_EVALUABLE and its reasons."""
    few = F.col("completed") < min_levels
    over = lambda c, most: F.when(F.coalesce(F.col(c) > most, F.lit(True)), f"{c}_too_high")
    reasons = F.when(few, F.array(F.lit("too_few_levels"))).otherwise(F.array_compact(F.array(over("mae", max_mae), over("rmse", max_rmse), over("no_call_rate", max_no_call))))
    verdict = F.when(few, "NOT_EVALUABLE").when(F.size(reasons) > 0, "FAIL").otherwise("PASS")
    return metrics.withColumn("verdict", verdict).withColumn("reasons", F.array_join(reasons, ","))


def assessable_extent(bins: DataFrame) -> DataFrame:
    """(chrom, first_used, last_used): where the used bins of a contig begin and end; null without any."""
    return bins.groupBy("chrom").agg(F.min(F.when(F.col("use"), F.col("start_pos"))).alias("first_used"), F.max(F.when(F.col("use"), F.col("end_pos"))).alias("last_used"))


def source_summary(calls: DataFrame) -> DataFrame:
    """(source, rows_total, rows_canonical, informative, ambiguous, skipped, read_groups) of calls (source, read_name, chrom, state).

    Rows on other contigs than 1 to 22, X and Y are skipped; M and U are informative.
    """
    canonical = F.coalesce(F.col("chrom").rlike("^chr([1-9]|1[0-9]|2[0-2]|X|Y)$"), F.lit(False))
    return calls.groupBy("source").agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(canonical).alias("rows_canonical"), F.count_if(canonical & F.col("state").isin("M", "U")).alias("informative"), F.count_if(canonical & (F.col("state") == "A")).alias("ambiguous"), F.count_if(~canonical).alias("skipped"), F.count_distinct(F.when(canonical, F.col("read_name"))).alias("read_groups"))


def phase_tally(reads: DataFrame) -> DataFrame:
    """(region, h1, h2, unphased, phase_sets) of reads (region, read_name, hp, ps)."""
    return reads.groupBy("region").agg(F.count_if(F.col("hp") == 1).alias("h1"), F.count_if(F.col("hp") == 2).alias("h2"), F.count_if(F.col("hp").isNull()).alias("unphased"), F.count_distinct("ps").alias("phase_sets"))


#: Levels of a sample up to which their table is broadcast.
MOST_LEVELS = 10_000


def sampled(rows: DataFrame, key: str, levels: DataFrame, seed: int) -> DataFrame:
    """(level, key): for each of ``levels(level, n)`` that many of the keys, without replacement.

    Keys are drawn in order of the MD5 of ``seed|level|key``; a level that asks for more keys
    than there are gets all. Counts of the 4096 ranges of the first three digits tell where a
    level's last key lies, so only keys up to that range are ordered, range by range.
    """
    wide = F.broadcast(levels) if levels.count() <= MOST_LEVELS else levels
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("level"), F.col(key).cast("string")))
    keyed = rows.select(key).distinct().join(wide, F.lit(True)).withColumn("h", h).withColumn("range", F.substring("h", 1, 3))
    counts = keyed.groupBy("level", "n", "range").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("level").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).where("before < n").select("level", "range", "before")
    order = Window.partitionBy("level", "range").orderBy("h", key)
    ranked = keyed.join(counts, ["level", "range"]).withColumn("rank", F.row_number().over(order) + F.col("before"))
    return ranked.where("rank <= n").select("level", key)


def current_states(envelopes: DataFrame) -> DataFrame:
    """(run, state) of status files (run, kind, state, at): a lock outranks a report, the latest of a kind counts."""
    last = F.max_by("state", F.struct(F.when(F.col("kind") == "lock", 1).otherwise(0).alias("lock"), "at"))
    return envelopes.groupBy("run").agg(last.alias("state"))


def resumable(stages: DataFrame, prior: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run, stage, action) of stages (run, stage, signature): SKIP if a prior run of the same signature concluded and all its artifacts verify, else RUN.

    ``prior(run, stage, signature, outcome)``, ``artifacts(run, stage, expected, found)``.
    """
    bad = artifacts.groupBy("run", "stage").agg(F.bool_and(F.coalesce(F.col("expected") == F.col("found"), F.lit(False))).alias("whole"))
    done = prior.where("outcome IN ('COMPLETED', 'NO_CALL')").select("run", "stage", "signature").distinct().withColumn("done", F.lit(True))
    rows = stages.join(done, ["run", "stage", "signature"], "left").join(bad, ["run", "stage"], "left")
    skip = F.coalesce("done", F.lit(False)) & F.coalesce("whole", F.lit(True))
    return rows.select("run", "stage", F.when(skip, "SKIP").otherwise("RUN").alias("action"))


def preflight(checks: DataFrame, by: str) -> DataFrame:
    """(by, worst, exit_code) of checks (by, status): FAIL 2, UNKNOWN and WARN 1, else 0; SKIPPED counts as nothing."""
    rank = F.when(F.col("status") == "FAIL", 3).when(F.col("status") == "UNKNOWN", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    worst = checks.groupBy(by).agg(F.max(rank).alias("r"))
    return worst.select(by, F.get(F.array(*map(F.lit, ("OK", "WARN", "UNKNOWN", "FAIL"))), F.col("r")).alias("worst"), F.when(F.col("r") == 3, 2).when(F.col("r") > 0, 1).otherwise(0).alias("exit_code"))


def determinable(criteria: DataFrame, by: str) -> DataFrame:
    """(by, determinable, blocking): a risk can be told only if every criterion (by, criterion, evaluable) can."""
    blocking = F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce("evaluable", F.lit(False)), F.col("criterion")))), ",")
    return criteria.groupBy(by).agg(F.bool_and(F.coalesce("evaluable", F.lit(False))).alias("determinable"), blocking.alias("blocking"))


def pins(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(component, state): MISSING, MISMATCH, EXTRA or PINNED of versions (component, version), which must be equal as text."""
    both = wanted.select("component", F.col("version").alias("want")).join(found.select("component", F.col("version").alias("have")), "component", "full")
    return both.select("component", F.when(F.col("have").isNull(), "MISSING").when(F.col("want").isNull(), "EXTRA").when(F.col("have") != F.col("want"), "MISMATCH").otherwise("PINNED").alias("state"))


def plan_against_execution(plan: DataFrame, execution: DataFrame) -> DataFrame:
    """(lane, state): of planned lanes COMPLETE, INCOMPLETE or NOT_EXECUTED, of executed ones without a plan UNPLANNED.

    ``plan(lane)``, ``execution(lane, outcome, has_evidence)``: complete is COMPLETED or NO_CALL with evidence at hand.
    """
    both = plan.select("lane", F.lit(True).alias("p")).join(execution, "lane", "full")
    done = F.col("outcome").isin("COMPLETED", "NO_CALL") & F.coalesce("has_evidence", F.lit(False))
    return both.select("lane", F.when(F.col("p").isNull(), "UNPLANNED").when(F.col("outcome").isNull(), "NOT_EXECUTED").when(done, "COMPLETE").otherwise("INCOMPLETE").alias("state"))


def specificity(lanes: DataFrame, by: str) -> DataFrame:
    """(by, complete, specificity) of lanes (by, state, fp, n): (n - fp) / n over all lanes.

    Not every lane assessed: no statement, rather than one over those that were.
    """
    complete = F.bool_and(F.col("state") != "NOT_RUN")
    return lanes.groupBy(by).agg(complete.alias("complete"), F.when(complete, F.round(F.try_divide(F.sum("n") - F.sum("fp"), F.sum("n")), 9)).alias("specificity"))


def quantitative_error(rows: DataFrame, by: str, found: Column, truth: Column) -> DataFrame:
    """(by, n, mae, bias) of ``found`` less ``truth``; rows where either is null do not count."""
    e = found - truth
    return rows.groupBy(by).agg(F.count(e).alias("n"), F.round(F.avg(F.abs(e)), 9).alias("mae"), F.round(F.avg(e), 9).alias("bias"))
