"""Event-time queries over the event log (additions: the batch twins of the streaming jobs)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from genostrata.operators.scratch import shared_folder
from genostrata.plans.registry import query
from genostrata.sources.fixtures import table
from genostrata.streaming import retention, watch


@query("stream_tumbling", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return watch.tumbling(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_sliding", """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events), w AS (SELECT h AS start FROM e UNION ALL SELECT h - INTERVAL 1 HOUR FROM e) SELECT CAST(start AS VARCHAR) AS start, count(*) AS n FROM w GROUP BY 1""")
def stream_sliding(spark, sf_dir):
    return watch.sliding(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS edge FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(edge) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS ended_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    s = watch.sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("ended_us"), "n")


_LEASE, _KEEP = 6 * 3600, 24 * 3600
_NOTE = lambda job, name, tm: f"list_append(s.o, {{'job': {job}, 'transition': {name}, 'at_us': {tm}}})"
_SETTLED = f"""CASE WHEN s.phase > 0 AND s.until <= x.tm THEN {{'job': s.job, 'phase': 0, 'until': CAST(0 AS BIGINT), 'o': {_NOTE('s.job', "CASE WHEN s.phase = 1 THEN 'lease_over' ELSE 'expired' END", 's.until')}, 'kind': '', 'own': s.own, 'tm': s.tm}} ELSE s END"""
_BLANK = "'kind': '', 'own': s.own, 'tm': s.tm"
_STEP = f"""CASE WHEN x.kind = 'start' AND s.phase = 0 THEN {{'job': x.own, 'phase': 1, 'until': x.tm + {_LEASE * 1_000_000}, 'o': {_NOTE('x.own', "'admitted'", 'x.tm')}, {_BLANK}}}
  WHEN x.kind = 'start' THEN {{'job': s.job, 'phase': s.phase, 'until': s.until, 'o': {_NOTE('x.own', "CASE WHEN s.phase = 1 THEN 'busy' ELSE 'answered' END", 'x.tm')}, {_BLANK}}}
  WHEN s.phase = 1 AND s.job = x.own AND x.kind = 'finish' THEN {{'job': s.job, 'phase': 2, 'until': x.tm + {_KEEP * 1_000_000}, 'o': {_NOTE('x.own', "'finished'", 'x.tm')}, {_BLANK}}}
  WHEN s.phase = 1 AND s.job = x.own AND x.kind = 'cancel' THEN {{'job': s.job, 'phase': 0, 'until': CAST(0 AS BIGINT), 'o': {_NOTE('x.own', "'cancelled'", 'x.tm')}, {_BLANK}}} ELSE s END"""
_NONE = "'job': CAST(0 AS BIGINT), 'phase': 0, 'until': CAST(0 AS BIGINT), 'o': CAST([] AS STRUCT(job BIGINT, transition VARCHAR, at_us BIGINT)[])"


@query("job_admissions", f"""WITH e AS (SELECT 'u' || user_id % 40 AS key, epoch_us(ts) AS tm, event_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'finish' ELSE 'cancel' END AS kind, event_id % 2 AS own FROM events),
l AS (SELECT key, list({{{_NONE}, 'kind': kind, 'own': CAST(own AS BIGINT), 'tm': tm}} ORDER BY tm, event_id) AS items FROM e GROUP BY key),
f AS (SELECT key, list_reduce(list_append(items, {{{_NONE}, 'kind': 'end', 'own': CAST(0 AS BIGINT), 'tm': (SELECT max(tm) FROM e)}}), lambda s, x: list_transform([{_SETTLED}], lambda s: {_STEP})[1], {{{_NONE}, 'kind': '', 'own': CAST(0 AS BIGINT), 'tm': CAST(0 AS BIGINT)}}) AS s FROM l),
o AS (SELECT key, unnest(s.o) AS t FROM f)
SELECT key, t.job, t.transition, t.at_us FROM o""")
def job_admissions(spark, sf_dir):
    """Drains the event log through the keyed state once; what it writes is the result."""
    before = spark.conf.get(retention.PROVIDER)
    spark.conf.set(retention.PROVIDER, retention.ROCKSDB)
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "finish").otherwise("cancel")
    own = [F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"), (F.col("event_id") % 2).alias("job")]
    folder = f"{shared_folder(spark)}/genostrata-{uuid.uuid4().hex}"
    try:
        schema = table(spark, sf_dir, "events").schema
        watch.run_available(spark, f"{sf_dir}/events.parquet", schema, lambda s: retention.admissions(s.select(*own), lease_seconds=_LEASE, keep_seconds=_KEEP), f"{folder}/out", f"{folder}/state")
    finally:
        spark.conf.set(retention.PROVIDER, before)
    return spark.read.schema(retention.OUTPUT).parquet(f"{folder}/out")
