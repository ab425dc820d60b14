"""Scans that stop at the first hit: rows in order of an offset are looked at window by window.

Each window is a job of its own over all executors, with bounds on the offset that reach the
files; windows grow, so a scan reads at most some times what it had to, and the least
offset wins however the rows are dealt. The outcome is that of looking at one row after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that end a scan, the state of a row without anything, and one that outweighs others.
STOPS, NOTHING, BROKEN = ("detected", "record_limit"), "nothing", "invalid"
#: Rows of the first window, and how much longer each next one is.
FIRST, GROWTH = 4096, 4


class _Scan:
    """Counts and problems so far of one scan."""

    def __init__(self, state: Column, most: int | None):
        self.state, self.left = state, most
        self.checked, self.problem = 0, None

    def look(self, rows: DataFrame, order: Column):
        """(place, state) of the first stop among ``rows`` in ``order``, or None; counts what comes up to it."""
        shown = rows.select(order.alias("place"), self.state.alias("state"))
        stop = shown.where(F.col("state").isin(*STOPS)).agg(F.min(F.struct("place", "state")).alias("s")).first()["s"]
        upto = shown
        if stop is not None:
            last = F.struct(*map(F.lit, stop["place"])) if isinstance(stop["place"], tuple) else F.lit(stop["place"])
            upto = shown.where(F.col("place") <= last.cast(shown.schema["place"].dataType))
        odd = ~F.col("state").isin(*STOPS, NOTHING)
        got = upto.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(odd, F.struct("place", "state"))).alias("p"), F.coalesce(F.bool_or(F.col("state") == BROKEN), F.lit(False)).alias("b")).first()
        self.checked += got["n"]
        if self.left is not None:
            self.left -= got["n"]
        if got["b"]:
            self.problem = BROKEN
        elif got["p"] is not None:
            self.problem = self.problem or got["p"]["state"]
        return stop


def bounded_scan(rows: DataFrame, offset: str, state: Column, *, most: int | None = None, starts: list[int] | None = None, witness: int | None = None, first: int = FIRST) -> DataFrame:
    """One row (reason, checked, complete, confirmed): what looking at ``rows`` in order of ``offset`` ends with.

    ``offset`` (long, unique) orders the rows; ``state`` (detected, record_limit, nothing, or
    a problem) is what a row shows, worked out for rows that are looked at. The scan ends
    at the first detected or record_limit, after ``most`` rows or at the end. Without a stop
    the reason is the problem met (invalid before others, else the first), or nothing if the
    scan is complete and sample_incomplete if not. ``starts`` samples instead: an equal share
    of ``most`` rows from each start up to the next, the later half of the starts first.
    ``witness``, the offset of an earlier hit, is looked at before anything else. Rows
    without an offset are left out.
    """
    base, scan = rows.where(F.col(offset).isNotNull()), _Scan(state, most)

    def result(reason: str, complete: bool = False, confirmed: int | None = None) -> DataFrame:
        return rows.sparkSession.createDataFrame([(reason, scan.checked, complete, confirmed)], "reason string, checked long, complete boolean, confirmed long")

    def stopped(stop, at: int) -> DataFrame:
        return result(stop["state"], confirmed=at if stop["state"] == "detected" else None)

    if witness is not None and (stop := scan.look(base.where(F.col(offset) == witness), F.col(offset))):
        return stopped(stop, stop["place"])
    if starts:
        for part in _samples(base, offset, scan, starts, most):
            if stop := scan.look(part, F.struct("__turn", offset)):
                return stopped(stop, stop["place"][1])
        return result(scan.problem or "sample_incomplete")
    low, high = base.agg(F.min(offset), F.max(offset)).first()
    while low is not None and low <= high and (scan.left is None or scan.left > 0):
        window = base.where((F.col(offset) >= low) & (F.col(offset) < low + first))
        if scan.left is not None:
            window = window.orderBy(offset).limit(scan.left)
        if stop := scan.look(window, F.col(offset)):
            return stopped(stop, stop["place"])
        low, first = low + first, first * GROWTH
    complete = most is None or scan.left > 0
    return result(scan.problem or (NOTHING if complete else "sample_incomplete"), complete=complete)


def _samples(base: DataFrame, offset: str, scan: _Scan, starts: list[int], most: int | None) -> Iterator[DataFrame]:
    """The rows of one start, then of the next 4, 16 and so on, with __turn."""
    order = sorted(set(starts))
    end = dict(zip(order, [*order[1:], None], strict=True))
    turns = order[len(order) // 2 :] + order[: len(order) // 2]
    share, at, size = max(1, (most or FIRST * len(turns)) // len(turns)), 0, 1
    while at < len(turns) and (scan.left is None or scan.left > 0):
        parts = []
        for turn in range(at, min(len(turns), at + size)):
            low, high = turns[turn], end[turns[turn]]
            inside = F.col(offset) >= low if high is None else (F.col(offset) >= low) & (F.col(offset) < high)
            parts.append(base.where(inside).orderBy(offset).limit(share).withColumn("__turn", F.lit(turn)))
        rows = reduce(DataFrame.unionByName, parts)
        yield rows if scan.left is None else rows.orderBy("__turn", offset).limit(scan.left)
        at, size = at + size, size * GROWTH
