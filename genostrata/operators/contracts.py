"""Consistency rules as queries: what they return breaks a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, rule) for each rule (name, SQL condition) that a row does not meet; unknown is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(condition), F.lit(False)), name) for name, condition in rules]))
    return rows.select(key, F.explode(broken).alias("rule"))


def not_decreasing(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order) where a value that may only fall along ``order`` rises."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("before", before).where(F.col(value) > F.col("before")).select(key, order)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def recomputed(report: DataFrame, again: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, column) where a report's number differs from the recomputed one, null only equal to null."""
    names = [c for c in report.columns if c != key]
    both = report.select(key, *[F.col(c).alias(f"a_{c}") for c in names]).join(again.select(F.col(key).alias("__key"), *[F.col(c).alias(f"b_{c}") for c in names]), F.col(key) == F.col("__key"), "full")
    differs = lambda c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"b_{c}"))), F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull())
    return both.select(F.coalesce(key, "__key").alias(key), F.explode(F.array_compact(F.array(*[F.when(differs(c), c) for c in names]))).alias("column"))
