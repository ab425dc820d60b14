"""Keyed state that expires by event time: one active job a key, results kept for a while.

A key admits one job at a time. A start while a job is active is refused; a job that does
not end within its lease fails; a finished job's result answers further starts until it
expires. Timers of the state store settle keys that hear nothing more, and every event
first settles what was due before it, so that the transitions are those of a replay in
order of time, however the stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, job long, transition string, at_us long"


@dataclass
class Slot:
    """What is kept of a key: a job, its phase (active or done) and when that ends, in microseconds."""

    job: int
    phase: str
    until: int


def settle(slot: Slot | None, now: int) -> tuple[Slot | None, list[tuple[int, str, int]]]:
    """The slot after all that is due by ``now``, and the transitions that were due."""
    if slot is None or slot.until > now:
        return slot, []
    return None, [(slot.job, "lease_over" if slot.phase == "active" else "expired", slot.until)]


def step(slot: Slot | None, kind: str, job: int, at: int, lease: int, keep: int) -> tuple[Slot | None, list[tuple[int, str, int]]]:
    """The slot after one event, and its transitions. Kinds: start, finish, cancel; others change nothing."""
    slot, out = settle(slot, at)
    if kind == "start":
        if slot is None:
            slot = Slot(job, "active", at + lease)
            out.append((job, "admitted", at))
        else:
            out.append((job, "busy" if slot.phase == "active" else "answered", at))
    elif kind in ("finish", "cancel") and slot is not None and slot.phase == "active" and slot.job == job:
        slot = Slot(job, "done", at + keep) if kind == "finish" else None
        out.append((job, "finished" if kind == "finish" else "cancelled", at))
    return slot, out


def admissions(events: DataFrame, *, lease_seconds: int, keep_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, job, transition, at_us) of a stream ``events(key string, ts timestamp, event_id long, kind string, job long)``.

    Events of a batch go in order of (ts, event_id). An event later than ``late`` behind the
    newest is left out, as a replay in order of time would have taken it before. Null keys,
    times, kinds and jobs are left out. Timers need the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    if "RocksDB" not in events.sparkSession.conf.get(PROVIDER):
        raise ValueError(f"{PROVIDER} must name the RocksDB state store")
    lease, keep = lease_seconds * 1_000_000, keep_seconds * 1_000_000

    class Admission(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.slot = handle.getValueState("slot", "job long, phase string, until long")

        def _get(self) -> Slot | None:
            return Slot(*self.slot.get()) if self.slot.exists() else None

        def _put(self, slot: Slot | None) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if slot is None:
                self.slot.clear()
            else:
                self.slot.update((slot.job, slot.phase, slot.until))
                self.handle.registerTimer(-(-slot.until // 1000))

        @staticmethod
        def _frame(key, out):
            return pd.DataFrame([(key[0], *t) for t in out], columns=["key", "job", "transition", "at_us"])

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            slot, out = self._get(), []
            frame = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
            for kind, job, at in frame[["kind", "job", "at_us"]].itertuples(index=False):
                slot, more = step(slot, kind, int(job), int(at), lease, keep)
                out += more
            self._put(slot)
            yield self._frame(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            slot, out = settle(self._get(), expiredTimerInfo.getExpiryTimeInMs() * 1000)
            if out:
                self._put(slot)
            yield self._frame(key, out)

        def close(self) -> None:
            pass

    rows = events.where("key IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL AND job IS NOT NULL").withWatermark("ts", late)
    rows = rows.withColumn("at_us", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(Admission(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
