"""Streams: readiness, ledgers and windows over an event log.

The batch functions take any DataFrame, streaming or not; ``run_available`` drains a
file source once, as a scheduled sweep does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of events no further apart than ``gap``: a quiet period closes one."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.session_window("ts", gap)
    out = rows.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of fixed windows."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """(start, n) of windows that overlap."""
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Events without repeats of ``keys`` that arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def readiness(files: DataFrame, now, quiet_seconds: int, marker: str = "DONE") -> DataFrame:
    """(folder, state) from (folder, name, modified ts): EMPTY, MARKER_MISSING, STILL_CHANGING or READY."""
    per = files.groupBy("folder").agg(F.count("name").alias("n"), F.bool_or(F.col("name") == marker).alias("marked"), F.max("modified").alias("last"))
    quiet = F.unix_timestamp(now) - F.unix_timestamp("last") >= quiet_seconds
    return per.select("folder", F.when(F.col("n") == 0, "EMPTY").when(~F.coalesce("marked", F.lit(False)), "MARKER_MISSING").when(~quiet, "STILL_CHANGING").otherwise("READY").alias("state"))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, modified ts) of every file in the folders of ``root``, for ``readiness``: not-ready folders too.

    File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))


def retained(events: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """(key, n_events, state): EXPIRED where the last event is ``ttl_seconds`` or more before the newest of all, else ACTIVE."""
    now = events.agg(F.max(at).alias("now"))
    last = events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.max(at).alias("last"))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    rows = last.join(F.broadcast(now), F.lit(True))
    return rows.select(key, "n_events", F.when(age >= ttl_seconds * 1_000_000, "EXPIRED").otherwise("ACTIVE").alias("state"))


def run_available(spark: SparkSession, source: str, schema: str, transform, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what lies in folder ``source`` now, exactly once over calls with one checkpoint.

    ``source`` may also be a single file.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader, source = reader.option("pathGlobFilter", place.getName()), str(place.getParent())
    stream = transform(reader.parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def keyed_ledger(events: DataFrame) -> DataFrame:
    """Streaming state per user: attempts so far and the latest state, updated with every batch."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts, last, name = state.get if state.exists else (0, -1, "")
        for frame in frames:
            attempts += len(frame)
            newest = frame.loc[frame["event_id"].idxmax()]
            if newest["event_id"] > last:
                last, name = int(newest["event_id"]), newest["event_type"]
        state.update((attempts, last, name))
        yield pd.DataFrame([(key[0], attempts, last, name)], columns=["user_id", "attempts", "last_id", "state"])

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, attempts long, last_id long, state string", "attempts long, last_id long, state string", "update", GroupStateTimeout.NoTimeout)
