"""Scans that stop early and state that expires, against looking at one row after the other."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from genostrata.operators import earlyexit
from genostrata.streaming import retention, watch


def plain_scan(rows, most=None):
    """(reason, checked, complete, confirmed) of (offset, state) one by one."""
    checked, problem = 0, None
    for offset, state in sorted(rows):
        if most is not None and checked >= most:
            return problem or "sample_incomplete", checked, False, None
        checked += 1
        if state in earlyexit.STOPS:
            return state, checked, False, offset if state == "detected" else None
        if state == "invalid" or (state != "nothing" and problem is None):
            problem = state
    if most is not None and checked >= most:
        return problem or "sample_incomplete", checked, False, None
    return problem or "nothing", checked, True, None


@pytest.mark.parametrize("partitions", [1, 5])
def test_scans_equal_a_plain_walk(spark, partitions):
    rng = random.Random(11)
    for n, kinds in ((0, ["nothing"]), (60, ["nothing"]), (60, ["nothing"] * 30 + ["odd", "invalid"]), (80, ["nothing"] * 30 + ["detected", "odd"]), (80, ["nothing"] * 40 + ["record_limit"])):
        rows = [(k * 3, rng.choice(kinds)) for k in range(n)]
        df = spark.createDataFrame([*rows, (None, "detected")], "o long, s string").repartition(partitions)
        for most in (None, 25):
            got = earlyexit.bounded_scan(df, "o", F.col("s"), most=most, first=16).first()
            assert tuple(got) == plain_scan(rows, most)


def test_an_early_hit_reads_little(spark, tmp_path):
    spark.range(200_000).withColumn("s", F.when(F.col("id").isin(700, 900, 150_000), "detected").otherwise("nothing")).write.parquet(str(tmp_path / "t"))
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def state(s):
        looked.add(1)
        return s

    got = earlyexit.bounded_scan(spark.read.parquet(str(tmp_path / "t")), "id", state("s"), first=1000).first()
    assert tuple(got) == ("detected", 701, False, 700) and looked.value < 5000


def test_samples_and_witness(spark):
    rows = [(k, "detected" if k in (130, 355) else "invalid" if k == 5 else "nothing") for k in range(400)]
    df = spark.createDataFrame(rows, "o long, s string")
    scan = lambda **how: tuple(earlyexit.bounded_scan(df, "o", F.col("s"), **how).first())
    # Starts 200, 300, then 0, 100: ten rows of each, and no hit among them.
    assert scan(starts=[0, 100, 200, 300], most=40) == ("invalid", 40, False, None)
    assert scan(starts=[0, 100, 200, 350], most=40) == ("detected", 16, False, 355)
    assert scan(starts=[200, 0, 300, 125], most=40) == ("detected", 36, False, 130)
    assert scan(witness=130, starts=[0], most=10) == ("detected", 1, False, 130)
    assert scan(witness=131, most=20) == ("invalid", 21 - 1, False, None)


SCHEMA = "key string, ts timestamp, event_id long, kind string, job long"


def plain_admissions(rows, lease, keep, end):
    """Transitions of rows (key, at, id, kind, job) in order of time, up to what is due at ``end``."""
    out, slots = [], {}

    def due(key, now):
        if key in slots and slots[key][2] <= now:
            job, phase, until = slots.pop(key)
            out.append((key, job, "lease_over" if phase == "active" else "expired", until))

    for key, at, _, kind, job in sorted(rows, key=lambda r: (r[1], r[2])):
        due(key, at)
        held = slots.get(key)
        if kind == "start":
            out.append((key, job, "admitted" if held is None else "busy" if held[1] == "active" else "answered", at))
            if held is None:
                slots[key] = (job, "active", at + lease)
        elif held and held[1] == "active" and held[0] == job and kind in ("finish", "cancel"):
            out.append((key, job, "finished" if kind == "finish" else "cancelled", at))
            if kind == "finish":
                slots[key] = (job, "done", at + keep)
            else:
                del slots[key]
    for key in list(slots):
        due(key, end)
    return sorted(out)


def test_a_stream_in_batches_equals_a_replay(spark, tmp_path):
    rng = random.Random(2)
    second = 1_000_000
    base = 1_700_000_000 * second
    rows = [(f"k{rng.randint(0, 7)}", base + i * 40 * second + rng.randint(0, 30) * second, i, rng.choice(["start", "start", "finish", "finish", "cancel", "other"]), rng.randint(0, 1)) for i in range(600)]
    spark.conf.set(retention.PROVIDER, retention.ROCKSDB)
    for n in range(4):
        part = rows[n * 150 : (n + 1) * 150] + ([(None, rows[-1][1], 9999, "start", 1)] if n == 3 else [])
        frame = pd.DataFrame([(k, pd.Timestamp(at, unit="us"), i, kind, job) for k, at, i, kind, job in part], columns=["key", "ts", "event_id", "kind", "job"])
        spark.createDataFrame(frame, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        watch.run_available(spark, str(tmp_path / "in"), SCHEMA, lambda s: retention.admissions(s, lease_seconds=900, keep_seconds=1500), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = plain_admissions(rows, 900 * second, 1500 * second, max(r[1] for r in rows))
    assert got == want and {t for _, _, t, _ in want} == {"admitted", "busy", "answered", "finished", "cancelled", "lease_over", "expired"}


def test_the_state_store_is_asked_for(spark):
    before = spark.conf.get(retention.PROVIDER)
    spark.conf.set(retention.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            retention.admissions(spark.createDataFrame([], SCHEMA), lease_seconds=1, keep_seconds=1)
    finally:
        spark.conf.set(retention.PROVIDER, before)
