"""Consensus of callers: greedy clustering around the first member.

Calls are taken in order of locus; each joins the first cluster whose head it matches, or
heads a new one. Heads reach MAX distance ahead, so contigs are cut into tiles: every tile is
clustered apart, given the heads that the tile before leaves open near its end. Tiles whose
given heads change are done again until none does, so no contig is gathered in one task and
dense contigs give the same clusters as sparse ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genostrata.functions.coords import contig_rank, normalize_contig
from genostrata.operators.running import with_serial
from genostrata.operators.scratch import Tables


@dataclass(frozen=True)
class Policy:
    """When two calls of one type are the same event.

    Both ends within ``max_distance``; lengths differ by at most ``max_length_ratio`` of the
    longer; spans overlap reciprocally by ``min_overlap`` (not asked of insertions and
    translocations). Known orientations must share one if ``use_orientation``; a caller's
    calls are kept apart unless ``merge_within_caller``.
    """

    max_distance: int = 500
    min_overlap: float = 0.5
    max_length_ratio: float = 0.35
    use_orientation: bool = True
    merge_within_caller: bool = True


#: Bases of a tile.
TILE = 100_000
#: Calls that one task clusters at a time, unless a tile holds more.
PACK = 20_000

_ORDER = ["start_pos", "end_pos", "start2", "end2", "event_id"]


def canonical(calls: DataFrame) -> DataFrame:
    """The columns that clustering reads, with the lesser locus of a pair first.

    ``calls(event_id, event_type, chrom, start_pos, end_pos)`` may also have caller, chrom2,
    start2, end2 (the second locus of a translocation), orientations (array of strand
    pairs, each reversed if the loci are swapped) and length_bp (the span where missing).
    """
    has = set(calls.columns)
    get = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    one = F.struct(contig_rank(F.col("chrom")).alias("rank"), normalize_contig(F.col("chrom")).alias("chrom"), F.col("start_pos").cast("long").alias("s"), F.col("end_pos").cast("long").alias("e"))
    two = F.struct(contig_rank(get("chrom2", "string")).alias("rank"), normalize_contig(get("chrom2", "string")).alias("chrom"), get("start2", "long").cast("long").alias("s"), get("end2", "long").cast("long").alias("e"))
    paired = get("chrom2", "string").isNotNull()
    rows = calls.select("event_id", "event_type", get("caller", "string").alias("caller"), one.alias("one"), two.alias("two"), paired.alias("paired"), get("orientations", "array<string>").alias("o"), get("length_bp", "long").alias("length_bp"))
    swapped = F.col("paired") & (F.col("two") < F.col("one"))
    first, second = F.when(swapped, F.col("two")).otherwise(F.col("one")), F.when(swapped, F.col("one")).when(F.col("paired"), F.col("two"))
    turned = F.transform("o", lambda s: F.when(swapped & (F.length(s) == 2), F.reverse(s)).otherwise(s))
    span = F.when(~F.col("event_type").isin("insertion", "translocation"), F.col("one.e") - F.col("one.s"))
    length = F.coalesce(F.col("length_bp"), span) if "length_bp" in has else F.coalesce(span, F.col("one.e") - F.col("one.s"))
    return rows.select("event_id", "event_type", "caller", first["chrom"].alias("chrom"), first["s"].alias("start_pos"), first["e"].alias("end_pos"), F.coalesce(second["chrom"], F.lit("")).alias("chrom2"), F.coalesce(second["s"], F.lit(-1)).alias("start2"), F.coalesce(second["e"], F.lit(-1)).alias("end2"), F.array_join(F.array_sort(F.coalesce(turned, F.array().cast("array<string>"))), ",").alias("strands"), length.cast("double").alias("length"))


def matches(h: tuple, x: tuple, kind: str, policy: Policy) -> int | None:
    """The distance of two calls (start, end, start2, end2, strands, length, callers), or None."""
    gap = max(abs(h[0] - x[0]), abs(h[1] - x[1]))
    if not policy.merge_within_caller and h[6] == x[6]:
        return None
    if policy.use_orientation and h[4] and x[4] and not h[4] & x[4]:
        return None
    if kind == "translocation":
        if h[2] < 0 or x[2] < 0:
            return None
        gap = max(gap, abs(h[2] - x[2]), abs(h[3] - x[3]))
        return gap if gap <= policy.max_distance else None
    if gap > policy.max_distance:
        return None
    if h[5] == h[5] and x[5] == x[5] and abs(h[5] - x[5]) > policy.max_length_ratio * max(h[5], x[5]):
        return None
    if kind == "insertion":
        return gap
    shared = max(0, min(h[1], x[1]) - max(h[0], x[0]))
    return gap if shared and min(shared / (h[1] - h[0]), shared / (x[1] - x[0])) >= policy.min_overlap else None


_TILE = ["event_type", "chrom", "chrom2", "tile"]


#: A new head is held against so many calls or more at once, against fewer one by one.
AT_ONCE = 12


def greedy(rows: pd.DataFrame, policy: Policy) -> pd.DataFrame:
    """event_id, head, distance and tile of calls, tile by tile; rows with ``given`` are open heads from before.

    Heads of pairs of loci are kept by their second start, so that a call is held against those near both of its loci only.
    """
    rows = rows.sort_values(_TILE + _ORDER)
    paired = (rows["event_type"] == "translocation").to_numpy()
    parts = [search(some, policy) for search, some in ((_one_by_one, rows[paired]), (_claimed, rows[~paired])) if len(some)]
    return pd.concat(parts) if parts else _one_by_one(rows, policy)


def _claimed(rows: pd.DataFrame, policy: Policy) -> pd.DataFrame:
    """``greedy`` of calls of one locus, from the heads' side: each new head takes what it matches of the calls behind it.

    A call goes to the first head that it matches either way, and calls are held against heads only,
    all of a window at once, which are many fewer than calls where these are dense.
    """
    column = lambda c: rows[c].to_numpy()
    s, e, length, given = column("start_pos").astype(np.int64), column("end_pos").astype(np.int64), column("length").astype(float), column("given").astype(bool)
    code = lambda c: pd.factorize(rows[c])[0]
    caller, (strands, sets) = code("caller"), pd.factorize(rows["strands"])
    sets = [frozenset(filter(None, x.split(","))) for x in sets]
    alike: dict[int, np.ndarray] = {}
    insertion = (rows["event_type"] == "insertion").to_numpy()
    block = np.cumsum(np.any([np.diff(code(c), prepend=-2) != 0 for c in _TILE], axis=0))
    bounds = np.append(np.flatnonzero(np.diff(block, prepend=0)), len(rows))
    head, distance = np.where(given, np.arange(len(rows)), -1), np.zeros(len(rows), np.int64)
    as_call = lambda i: (int(s[i]), int(e[i]), -1, -1, sets[strands[i]], float(length[i]), caller[i])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        last = (np.searchsorted(s[lo:hi], s[lo:hi] + policy.max_distance, "right") + lo).tolist()
        kind = "insertion" if insertion[lo] else "other"
        for i in range(lo, hi):
            if head[i] >= 0 and head[i] != i:
                continue
            head[i] = i
            if last[i - lo] - i - 1 < AT_ONCE:
                for j in range(i + 1, last[i - lo]):
                    if head[j] < 0 and (gap := matches(as_call(i), as_call(j), kind, policy)) is not None:
                        head[j], distance[j] = i, gap
                continue
            x = np.flatnonzero(head[i + 1 : last[i - lo]] < 0) + i + 1
            gap = np.maximum(np.abs(s[x] - s[i]), np.abs(e[x] - e[i]))
            good = (gap <= policy.max_distance) & ~(np.abs(length[x] - length[i]) > policy.max_length_ratio * np.maximum(length[x], length[i]))
            if not policy.merge_within_caller:
                good &= caller[x] != caller[i]
            if policy.use_orientation and (mine := sets[strands[i]]):
                if strands[i] not in alike:
                    alike[strands[i]] = np.array([not other or bool(mine & other) for other in sets])
                good &= alike[strands[i]][strands[x]]
            x, gap = x[good], gap[good]
            if not insertion[i]:
                shared = np.minimum(e[x], e[i]) - np.maximum(s[x], s[i])
                some = shared > 0
                x, gap, shared = x[some], gap[some], shared[some]
                near = np.minimum(shared / (e[i] - s[i]), shared / (e[x] - s[x])) >= policy.min_overlap
                x, gap = x[near], gap[near]
            head[x], distance[x] = i, gap
    event, own = rows["event_id"], ~given
    found = rows.loc[own, ["event_id", *_TILE]]
    found.insert(1, "head", event.to_numpy()[head[own]])
    found.insert(2, "distance", distance[own])
    return found


def _one_by_one(rows: pd.DataFrame, policy: Policy) -> pd.DataFrame:
    reach = max(1, policy.max_distance)
    bins: dict[int, list[tuple]] = {}
    found, here = [], None
    columns = [rows[c].tolist() for c in (*_TILE, "event_id", "start_pos", "end_pos", "start2", "end2", "strands", "length", "caller", "given")]
    for number, (*place, event, s, e, s2, e2, strands, length, caller, given) in enumerate(zip(*columns, strict=True)):
        if place != here:
            here, bins = place, {}
        x = (s, e, s2, e2, frozenset(filter(None, strands.split(","))), length, caller)
        at = s2 // reach if place[0] == "translocation" else 0
        if not given:
            best = None
            for near in (at - 1, at, at + 1):
                if near in bins:
                    # Of a bin's open heads, in order of number, the first match.
                    bins[near] = [h for h in bins[near] if s - h[2][0] <= policy.max_distance]
                    for head in bins[near]:
                        if best is not None and head[0] > best[0]:
                            break
                        if (gap := matches(head[2], x, place[0], policy)) is not None:
                            best = (head[0], head[1], gap)
                            break
            if best is not None:
                found.append((event, best[1], best[2], *place))
            else:
                found.append((event, event, 0, *place))
                given = True
        if given:
            bins.setdefault(at, []).append((number, event, x))
    return pd.DataFrame(found, columns=["event_id", "head", "distance", *_TILE])


def _alike(rows: DataFrame, policy: Policy) -> tuple[DataFrame, list[str], Column]:
    """The first call of each kind of equal calls, what makes calls equal, and if equal calls match each other.

    What a call matches hangs on its columns alone, matching goes both ways, and equal calls stand
    at one place of the order. So all of a kind match the head that its first one does; where
    that is a head itself, so are the others, unless they match it.
    """
    same = ["event_type", "chrom", "chrom2", "start_pos", "end_pos", "start2", "end2", "strands", "length", *([] if policy.merge_within_caller else ["caller"])]
    known = F.col("length").isNotNull() & ~F.isnan("length")
    # matches(x, x): a pair needs its second locus, a span a base, and a caller may have to be another.
    itself = F.when(F.col("event_type") == "translocation", F.col("start2") >= 0).when(F.col("event_type") == "insertion", True).otherwise(F.col("end_pos") > F.col("start_pos"))
    unlike = known & (F.col("length") < 0)  # no ratio of a length below 0 is small enough
    itself = itself & ((F.col("event_type") == "translocation") | ~unlike) if policy.merge_within_caller else F.lit(False)
    firsts = rows.groupBy(*same, "tile").agg(F.min("event_id").alias("event_id"))
    if policy.merge_within_caller:
        firsts = firsts.withColumn("caller", F.lit(None).cast("string"))
    return firsts.withColumn("given", F.lit(False)), same, F.coalesce(itself, F.lit(False))


def cluster_calls(calls: DataFrame, policy: Policy = Policy(), *, tile: int = TILE, repeated: bool = False) -> DataFrame:
    """(event_id, head, distance): greedy clusters in order of locus within type and contigs.

    Event ids must be unique; rows with a null contig or coordinate are left out. With
    ``repeated``, calls that are equal in all that matching reads are searched as one: the same
    clusters, for tables where many are. The result is a written table.
    """
    by = _TILE
    width = max(tile, policy.max_distance + 1)
    kind = calls.schema["event_id"].dataType.simpleString()
    schema = f"event_id {kind}, head {kind}, distance long, event_type string, chrom string, chrom2 string, tile long"
    with Tables(calls.sparkSession) as tables:
        rows = canonical(calls).where("chrom IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL")
        every = rows.withColumn("tile", F.expr(f"start_pos div {width}"))
        if repeated:
            firsts, same, itself = _alike(every, policy)
        rows = tables.written(firsts if repeated else every.withColumn("given", F.lit(False)))
        packs = max(1, rows.count() // PACK)

        def clustered(some: DataFrame) -> DataFrame:
            # Many tiles share a call; a tile is never parted.
            return some.groupBy(F.pmod(F.xxhash64(*by), F.lit(packs))).applyInPandas(lambda g: greedy(g, policy), schema)

        done, sent = tables.written(clustered(rows)), None
        while True:
            # Heads near the end of a tile stay open in the next one, whose first calls may be theirs.
            edge = rows.where(F.col("start_pos") >= (F.col("tile") + 1) * width - policy.max_distance)
            near = edge.join(done.where("event_id = head").select("event_id"), "event_id", "left_semi")
            near = tables.written(near.withColumn("tile", F.col("tile") + 1).withColumn("given", F.lit(True)).select(rows.columns))
            names = [*by, "event_id"]
            changed = near.select(names) if sent is None else near.select(names).exceptAll(sent.select(names)).union(sent.select(names).exceptAll(near.select(names)))
            again = tables.written(changed.select(*by).distinct())
            redo = rows.join(again, by, "left_semi").select(rows.columns)
            if redo.isEmpty():
                if not repeated:
                    return tables.kept(done.select("event_id", "head", "distance"))
                firsts = rows.join(done.select("event_id", "head", "distance"), "event_id").select(*[F.col(c).alias(f"o_{c}") for c in same], F.col("event_id").alias("first"), "head", "distance")
                alike = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in same]
                own = (F.col("first") == F.col("head")) & ~itself
                all_calls = every.join(firsts, reduce(Column.__and__, alike))
                return tables.kept(all_calls.select("event_id", F.when(own, F.col("event_id")).otherwise(F.col("head")).alias("head"), "distance"))
            redo = redo.unionByName(near.join(again, by, "left_semi").select(rows.columns))
            before, done = done, tables.written(done.join(again, by, "left_anti").select(done.columns).unionByName(clustered(redo)))
            tables.dropped(before, sent, again)  # a round leaves its clusters and the heads it was given
            sent = near


def merged(calls: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster: the member of most support stands for it, with callers, members and evidence.

    cluster_id is SVCLUSTER- and a number of six digits or more, in order of the heads: by
    type, contigs in natural order, positions and id. Evidence lists caller, support and event
    of each member in order of event. The result is a written table.
    """
    rank = lambda c: contig_rank(F.col(c), other=100)
    with Tables(calls.sparkSession) as tables:
        names = ["chrom", "start_pos", "end_pos", "chrom2", "start2", "end2"]
        # A call's place is made after the join, and kept of heads only, so it is not shuffled with the calls.
        members = calls.join(clusters, "event_id")
        members = canonical(members.withColumn("event_id", F.struct(*members.columns))).select("event_id.*", F.struct(F.col("event_type").alias("kind"), *names).alias("__place"))
        best = F.min_by(F.struct("chrom", "event_type", "start_pos", "end_pos", "event_id"), F.struct(-F.col("support_reads"), "event_id"))
        evidence = F.array_sort(F.collect_list(F.struct("event_id", "caller", "support_reads")))
        # A head is a member of its cluster: its place comes with it, not from the calls anew.
        place = F.max(F.when(F.col("event_id") == F.col("head"), F.col("__place"))).alias("place")
        per = members.groupBy("head").agg(best.alias("r"), F.array_sort(F.collect_set("caller")).alias("callers"), evidence.alias("evidence"), F.max("distance").alias("max_distance"), place)
        placed = tables.written(per.select("*", "place.*").drop("place"))
        order = ["kind", rank("chrom"), "chrom", "start_pos", "end_pos", rank("chrom2"), "chrom2", "start2", "end2", "head"]
        placed = with_serial(placed, order, "number", tables)
        name = F.concat(F.lit("SVCLUSTER-"), F.when(F.col("number") < 1_000_000, F.lpad(F.col("number").cast("string"), 6, "0")).otherwise(F.col("number").cast("string")))
        status = F.when(F.size("callers") >= 2, "technically_supported").otherwise("detected")
        ids = F.transform("evidence", lambda e: e["event_id"])
        out = placed.select(name.alias("cluster_id"), "head", "r.chrom", "r.event_type", "r.start_pos", "r.end_pos", F.col("r.event_id").alias("representative"), F.array_join("callers", ",").alias("callers"), F.size("evidence").alias("n_members"), F.array_distinct(ids).alias("sources"), "evidence", "max_distance", status.alias("status"))
        return tables.kept(out)
