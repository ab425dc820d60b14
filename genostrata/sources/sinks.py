"""Writers: documents, delimited views, manifests and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genostrata.functions.text import safe_cell


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines; the committer makes the folder appear whole or not at all."""
    df.write.json(path)


def write_view(df: DataFrame, path: str) -> None:
    """Delimited text with a header, nested columns as JSON, leading formula signs quoted."""
    columns = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.to_json(f.name) if kind in ("struct", "array", "map") else F.col(f.name)
        columns.append((safe_cell(c.cast("string")) if kind in ("string", "struct", "array", "map") else c).alias(f.name))
    df.select(*columns).write.option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, size, name) of every file of a folder, in order of name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.substring_index("path", "/", -1).alias("name")).orderBy("name")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n_rows, columns, and a digest that does not depend on order.

    The digest is the decimal sum over rows of the first 48 bits of the SHA-256 of the row's
    values joined by ``|``; nulls are left out of the join, so columns should not be null.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(",".join(df.columns)).alias("columns"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def schemas(tables: dict[str, DataFrame]) -> dict[str, str]:
    return {name: df.schema.json() for name, df in tables.items()}


def write_annotation(df: DataFrame, path: str) -> None:
    """An annotation table in one folder for each contig, so a query on a contig reads only its files.

    Ranges of (contig, start) are written apart, so a large contig is several files of known bounds.
    """
    df.repartitionByRange("chrom", "start_pos").sortWithinPartitions("chrom", "start_pos").write.partitionBy("chrom").parquet(path)
