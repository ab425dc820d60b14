"""A stored index of intervals: point lookups read the files that can hold a hit, not the table.

Intervals are written by piece: those of one contig and one class of length, in order of
start, cut into ranges of bounded size. A small table keeps each piece's first start and
greatest end. Classes of length keep a few long intervals from stretching every piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genostrata.operators.rangejoin import BIN, interval_level, overlap_join, point_join
from genostrata.operators.scratch import Tables
from genostrata.sources.published import opened, publish, recounted

#: Intervals in one piece, about.
PIECE_ROWS = 100_000
#: Bases of the cells by which points are summed up before pieces are looked for.
CELL = 4096
#: Up to so many piece numbers become literals of the scan; more are joined.
MOST_LISTED = 5000


def source_signature(spark: SparkSession, path: str) -> list[list]:
    """(path, length, modification time) of the files behind ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    return [[r["path"], r["length"], r["at"]] for r in files.orderBy("path").collect()]


def store_intervals(intervals: DataFrame, folder: str, *, source: str | None = None, piece_rows: int = PIECE_ROWS) -> str:
    """Publish ``intervals(chrom, start_pos, end_pos, ...)`` as an index under ``folder``; its version's path.

    Null or empty intervals hold no point and are left out. ``source``, the path they were
    read from, is remembered with lengths and times of its files.
    """
    spark = intervals.sparkSession
    level = interval_level(F.col("end_pos") - F.col("start_pos"), BIN)
    rows = intervals.where("chrom IS NOT NULL AND start_pos < end_pos").withColumn("level", level)
    with Tables(spark) as tables:
        rows = tables.written(rows)
        n = rows.count()
        # Ranges of (contig, class, start) are told apart by a number; equal starts may fall to either side.
        ranged = rows.repartitionByRange(max(1, -(-n // piece_rows)), "chrom", "level", "start_pos", F.monotonically_increasing_id())
        ranged = tables.written(ranged.sortWithinPartitions("chrom", "level", "start_pos").withColumn("range", F.spark_partition_id()))
        pieces = ranged.groupBy("chrom", "level", "range").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n"))
        pieces = pieces.withColumn("piece", F.concat_ws("-", "chrom", F.col("level").cast("string"), F.col("range").cast("string")))
        stored = ranged.withColumn("piece", F.concat_ws("-", "chrom", F.col("level").cast("string"), F.col("range").cast("string"))).drop("level", "range")
        # Each range has few pieces, so a task writes few files; within one they are in order of start.
        stored = stored.repartition("piece").sortWithinPartitions("piece", "start_pos")
        facts = {"kind": "interval index", "source": source, "signature": source_signature(spark, source) if source else None}
        return publish(spark, folder, {"pieces": (pieces.coalesce(1) if n <= piece_rows * MOST_LISTED else pieces, []), "intervals": (stored, ["piece"])}, facts)


def open_intervals(spark: SparkSession, version: str) -> str:
    """``version`` if it is a whole index of a source that has not changed, else an error."""
    facts = recounted(spark, version)
    if facts.get("kind") != "interval index":
        raise ValueError(f"{version} is no interval index")
    if facts["source"] and source_signature(spark, facts["source"]) != facts["signature"]:
        raise ValueError(f"{facts['source']} has changed since it was indexed")
    return version


def touched_intervals(points: DataFrame, version: str) -> DataFrame:
    """The stored intervals of the pieces that can hold one of ``points(l_chrom, l_pos)``."""
    spark = points.sparkSession
    pieces = opened(spark, version, "pieces").select(F.col("chrom").alias("r_chrom"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"), "piece")
    # From the first to the last point of each cell: there are far fewer cells than points, however dense these are.
    places = points.groupBy("l_chrom", F.expr(f"l_pos div {CELL}")).agg(F.min("l_pos").alias("l_start"), (F.max("l_pos") + 1).alias("l_end")).select("l_chrom", "l_start", "l_end")
    wanted = overlap_join(places, pieces).select("piece").distinct()
    stored = opened(spark, version, "intervals")
    listed = [r["piece"] for r in wanted.limit(MOST_LISTED + 1).collect()]
    if len(listed) <= MOST_LISTED:
        return stored.where(F.col("piece").isin(listed))
    return stored.join(wanted, "piece", "left_semi")


def stored_point_join(points: DataFrame, version: str) -> DataFrame:
    """``points(l_chrom, l_pos, ...)`` with the columns of each stored interval that holds them."""
    found = touched_intervals(points, version).drop("piece")
    names = {"chrom": "r_chrom", "start_pos": "r_start", "end_pos": "r_end"}
    return point_join(points, found.withColumnsRenamed(names))
