from pyspark.sql import functions as F

from fixture_paths import TINY
from genostrata.streaming import watch


def test_drained_stream_equals_batch_and_runs_once(spark, tmp_path):
    events = spark.read.parquet(f"{TINY}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    events.repartition(3).write.parquet(source)
    args = (spark, source, events.schema.simpleString()[7:-1].replace(":", " "), lambda s: watch.distinct_within(s, ["event_id"], "1 hour"), sink, checkpoint)
    watch.run_available(*args)
    watch.run_available(*args)  # nothing new: nothing twice
    assert spark.read.parquet(sink).count() == events.select("event_id").distinct().count()


def test_keyed_state_equals_last_per_key(spark, tmp_path):
    events = spark.read.parquet(f"{TINY}/events.parquet").select("event_id", "user_id", "event_type")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = watch.keyed_ledger(spark.readStream.schema(events.schema).parquet(source))
    query = stream.writeStream.format("memory").queryName("ledger").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["user_id"]: (r["attempts"], r["last_id"], r["state"]) for r in spark.table("ledger").collect()}
    want = {r["user_id"]: (r["n"], r["last"], r["state"]) for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("state")).collect()}
    assert got == want


def test_readiness(spark):
    files = spark.createDataFrame([("a", "x", "2024-01-01 00:00:00"), ("a", "DONE", "2024-01-01 00:00:00"), ("b", "x", "2024-01-01 00:00:00"), ("c", "DONE", "2024-01-01 01:00:00"), ("d", None, None)], "folder string, name string, modified string").withColumn("modified", F.to_timestamp("modified"))
    got = dict(watch.readiness(files, F.to_timestamp(F.lit("2024-01-01 01:00:10")), 60).collect())
    assert got == {"a": "READY", "b": "MARKER_MISSING", "c": "STILL_CHANGING", "d": "EMPTY"}


def test_discovery_lists_folders_that_are_not_ready(spark, tmp_path):
    for folder, names in {"a": ["x", "DONE"], "b": ["y"]}.items():
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_text("1")
    found = watch.discovered(spark, str(tmp_path))
    got = dict(watch.readiness(found, F.current_timestamp() + F.expr("interval 2 hours"), 60).collect())
    assert got == {"a": "READY", "b": "MARKER_MISSING"}
