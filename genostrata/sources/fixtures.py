"""Projections of the driver's tables into domain tables, one text for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POS = "(l_partkey * 7919 + l_orderkey * 104729) % 5000000"
_LEN = "CAST(l_quantity AS BIGINT) * 50"

#: name: (table, row filter, expressions)
PROJECTIONS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "contigs": ("nation", "n_nationkey < 22", ("CAST(1 + n_nationkey AS INT) AS ord", "concat('chr', CAST(1 + n_nationkey AS STRING)) AS chrom", "CAST(5200000 AS BIGINT) AS length")),
    "calls": ("lineitem", "TRUE", (
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS event_id",
        "concat('chr', CAST(1 + l_suppkey % 22 AS STRING)) AS chrom",
        f"{_POS} AS start_pos",
        f"{_POS} + {_LEN} AS end_pos",
        "CASE l_linenumber % 4 WHEN 0 THEN 'deletion' WHEN 1 THEN 'duplication' WHEN 2 THEN 'inversion' ELSE 'insertion' END AS event_type",
        "CASE WHEN l_linestatus = 'F' THEN 'caller_a' ELSE 'caller_b' END AS caller",
        "CAST(l_quantity AS INT) AS support_reads",
        "l_discount AS vaf",
        "CASE WHEN l_returnflag = 'R' THEN 'LOWQ' ELSE 'PASS' END AS filter",
        "CAST(CASE WHEN l_tax >= 0.04 THEN 3.0 ELSE 1.0 END AS DOUBLE) AS copy_number",
    )),
    "pairs": ("lineitem", "l_linenumber <= 3", (
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS event_id",
        "'translocation' AS event_type",
        "concat('chr', CAST(1 + l_partkey % 3 AS STRING)) AS chrom",
        "(l_partkey * 7919) % 50 * 20000 + CAST(l_quantity AS BIGINT) * 20 AS start_pos",
        "(l_partkey * 7919) % 50 * 20000 + CAST(l_quantity AS BIGINT) * 20 + 1 AS end_pos",
        "concat('chr', CAST(1 + l_suppkey % 3 AS STRING)) AS chrom2",
        "(l_suppkey * 104729) % 50 * 20000 + CAST(l_quantity AS BIGINT) * 10 AS start2",
        "(l_suppkey * 104729) % 50 * 20000 + CAST(l_quantity AS BIGINT) * 10 + 1 AS end2",
        "CASE WHEN l_linestatus = 'F' THEN 'caller_a' ELSE 'caller_b' END AS caller",
        "CAST(l_quantity AS INT) AS support_reads",
        "CASE WHEN l_returnflag = 'A' THEN '+-' WHEN l_returnflag = 'R' THEN '-+' END AS strands",
    )),
    "targets": ("part", "TRUE", (
        "p_partkey AS target_id",
        "concat('chr', CAST(1 + p_partkey % 22 AS STRING)) AS chrom",
        "(CAST(p_partkey AS BIGINT) * 15485863) % 5000000 AS start_pos",
        "(CAST(p_partkey AS BIGINT) * 15485863) % 5000000 + 2000 + p_size * 1000 AS end_pos",
        "p_brand AS label",
        "p_retailprice / 50.0 AS mean_depth",
    )),
    "sites": ("events", "TRUE", (
        "event_id AS site_id",
        "concat('chr', CAST(1 + user_id % 22 AS STRING)) AS chrom",
        "(event_id * 7919) % 5000000 AS pos",
        "CASE WHEN event_type IN ('view', 'click') THEN 'm' ELSE 'h' END AS code",
        "1 + (event_id * 31) % 40 AS valid_coverage",
        "CAST(floor(value) AS BIGINT) % (2 + (event_id * 31) % 40) AS modified_calls",
    )),
    "reads": ("events", "TRUE", (
        "CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS source",
        "concat('read', CAST(user_id AS STRING)) AS read_name",
        "event_id % 40 AS marker_id",
        "event_id",
        "value - 50.0 AS llr",
        "1 + event_id % 3 AS num_motifs",
    )),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, where, exprs = PROJECTIONS[name]
    return table(spark, sf_dir, source).where(where).selectExpr(*exprs)


def sql(*names: str) -> str:
    """``WITH`` list of the projections ``fx_<name>`` for an oracle."""
    return ",\n".join(f"fx_{n} AS (SELECT {', '.join(PROJECTIONS[n][2])} FROM {PROJECTIONS[n][0]} WHERE {PROJECTIONS[n][1]})" for n in names)
