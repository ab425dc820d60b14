"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are cut into blocks. Block k of a source of weight
w is released at slot floor(k / w) and due at slot ceil((k + 1) / w); at every slot the
released block of earliest deadline runs. So after t slots of a phase each source has had
within less than one block of its share w * t. Weights are exact: floats are fractions, and
releases and deadlines are whole numbers found from them without rounding. The driver lays
out the slot of every block (8 bytes for each block, not for each document); the executors
read it from a table by source and stretch of blocks. When a source has run out, the others
go on as a new phase with their weights scaled up. Every document gets one place.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genostrata.llm.common import materialise, read

BLOCK_DOCS = 64
#: Without targets, weights follow the sources' sizes to this power.
TEMPERATURE = 0.5
#: Blocks of a source whose slots are one row of the plan, and rows up to which it is broadcast.
STRETCH = 256
MOST_BROADCAST = 5000
#: Documents in one range of a source's hash order; ranges are ranked apart.
RANGE_DOCS = 2000


def whole_units(weights: dict[str, float], total: int) -> dict[str, int]:
    """Positive whole numbers near the weights' shares of ``total``, by largest remainder."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    scale = sum(weights.values())
    share = {k: w / scale * total for k, w in weights.items()}
    units = {k: max(1, int(x)) for k, x in share.items()}
    spare = total - sum(units.values())
    for k in sorted(share, key=lambda k: (int(share[k]) - share[k], k))[: max(0, spare)]:
        units[k] += 1
    return units


def earliest_deadline_first(units: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(units) slots."""
    period = sum(units.values())
    slots: dict[str, list[int]] = {k: [] for k in units}
    waiting = [(0, k, 0) for k in units]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, k, b = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(b + 1) * period // units[k]), k, b))
        _, k, b = heapq.heappop(ready)
        slots[k].append(t)
        if b + 1 < units[k]:
            heapq.heappush(waiting, (max(t + 1, (b + 1) * period // units[k]), k, b + 1))
    return slots


def phases(units: dict[str, int], blocks: dict[str, int]) -> dict[str, list[tuple]]:
    """(first, next, units, offset, period, slots) of each phase a source takes part in.

    The schedule of ``block_slots`` for units of a short period, which tests compare it with.
    Blocks first <= k < next of the source run at offset + slots of the phase's periods.
    """
    left = {k: n for k, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    plan: dict[str, list[tuple]] = {k: [] for k in blocks}
    offset = 0
    while left:
        now = {k: units[k] for k in left}
        period, slots = sum(now.values()), earliest_deadline_first(now)
        length = min((left[k] - 1) // now[k] * period + slots[k][(left[k] - 1) % now[k]] + 1 for k in left)
        for k in list(left):
            ran = length // period * now[k] + sum(s < length % period for s in slots[k])
            if ran:
                plan[k].append((done[k], done[k] + ran, now[k], offset, period, slots[k]))
            done[k] += ran
            left[k] -= ran
            if not left[k]:
                del left[k]
        offset += length
    return plan


def exact_units(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("target weights must be positive")
    parts = {k: Fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in parts.values()))
    units = {k: int(x * scale) for k, x in parts.items()}
    common = math.gcd(*units.values())
    return {k: n // common for k, n in units.items()}


def block_slots(units: dict[str, int], blocks: dict[str, int]) -> dict[str, array]:
    """The slot of every block of every source: the schedule of ``phases``, laid out to its end.

    ``units`` may be of any size, since no period is laid out.
    """
    slots = {k: array("q") for k in blocks}
    left = {k: n for k, n in blocks.items() if n > 0}
    t = 0
    while left:
        total, start = sum(units[k] for k in left), t
        ready = [(-(-total // units[k]), k, 0) for k in left]  # deadline, source, block
        heapq.heapify(ready)
        waiting: list[tuple[int, str, int]] = []  # release, source, block
        over = None
        while over is None:
            while waiting and waiting[0][0] <= t - start:
                _, k, b = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(b + 1) * total // units[k]), k, b))
            _, k, b = heapq.heappop(ready)
            slots[k].append(t)
            t += 1
            if b + 1 < left[k]:
                heapq.heappush(waiting, (max(t - start, (b + 1) * total // units[k]), k, b + 1))
            else:
                over = k
        left = {k: blocks[k] - len(slots[k]) for k in left if k != over}
    return slots


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, *, temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with block, slot and in_block: the mixture in order of (slot, in_block).

    ``weights`` gives each source its target; every source of ``docs`` must have one
    (ValueError else), targets without rows are ignored. Without it weights are the
    sources' sizes to the power ``temperature``. A null source is a source. Repeated rows
    each get a place, rows of equal doc_id in any order; a null doc_id is an id like any
    other. Columns of ``docs`` by the three new names are replaced. An empty table stays
    empty. No row is repeated or left out.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("block", "slot", "in_block")]
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    # The row travels as one column, so its names cannot clash with those used here.
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = docs.select(row.alias("row"), src.alias("src"), F.col(doc_id).alias("id"), F.xxhash64(F.lit(17), F.col(doc_id)).alias("h"))
    sizes = {r["src"]: r["n"] for r in rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        target = {k: n**temperature for k, n in sizes.items()}
    else:
        given = {"null" if k is None else f"={k}": w for k, w in weights.items()}
        if missing := sorted(sizes.keys() - given.keys()):
            raise ValueError(f"no target weight for {missing}")
        target = {k: given[k] for k in sizes}
    plan = block_slots(exact_units(target), {k: -(-n // block_docs) for k, n in sizes.items()}) if sizes else {}
    table = spark.createDataFrame([(k, max(0, (n // RANGE_DOCS).bit_length())) for k, n in sizes.items()], "src string, bits int")
    table = F.broadcast(table) if len(sizes) <= MOST_BROADCAST else table
    keys = [(k, at) for k in plan for at in range(0, len(plan[k]), STRETCH)]
    slots = pa.array([np.frombuffer(plan[k], np.int64)[at : at + STRETCH] for k, at in keys], pa.list_(pa.int64()))
    places = pa.table({"src": pa.array([k for k, _ in keys], pa.string()), "stretch": pa.array([at // STRETCH for _, at in keys], pa.int64()), "slots": slots})
    places = spark.createDataFrame(places, "src string, stretch long, slots array<long>")
    places = F.broadcast(places) if len(keys) <= MOST_BROADCAST else materialise(places)

    ranged = rows.join(table, "src").withColumn("range", F.expr("pmod(h, shiftleft(1L, bits))"))
    counts = ranged.groupBy("src", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("src", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_range = Window.partitionBy("src", "range").orderBy("h", "id")
    ranked = ranged.withColumn("r", F.row_number().over(in_range) - 1).join(starts, ["src", "range"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("r")).withColumn("block", F.expr(f"rank div {block_docs}"))
    placed = ranked.withColumn("stretch", F.expr(f"block div {STRETCH}")).join(places, ["src", "stretch"])
    slot = F.expr(f"get(slots, cast(block % {STRETCH} as int))")
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]
    return placed.select(*own, "block", slot.alias("slot"), (F.col("rank") % block_docs).cast("int").alias("in_block"))


def op2_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's source, block, slot and place in the block."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture."""
    return mix(docs)
