"""Totals of what lies over a region, without a table of pairs.

Contigs are cut into tiles. A region goes to the tile of its start; points and calls go to each tile
whose regions they can meet, two or three of them. Within a tile totals come from sorted places and
sums up to them, so a task's work grows with its rows and not with the pairs among them. What is
longer than a tile is for the caller to join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bases of a tile.
TILE = 65_536


def _upto(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])


def range_max(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, none: int) -> np.ndarray:
    """The greatest of ``values[lo:hi]``, or ``none``."""
    out = np.full(len(lo), none)
    size = np.frexp(np.maximum(hi - lo, 0).astype(float))[1] - 1  # -1 where empty
    level = values
    for k in range(int(size.max(initial=-1)) + 1):
        if k:
            level = np.maximum(level[: -(1 << (k - 1))], level[1 << (k - 1) :])
        own = size == k
        out[own] = np.maximum(level[lo[own]], level[hi[own] - (1 << k)])
    return out


def covered_max(n: int, lo: np.ndarray, hi: np.ndarray, values: np.ndarray, none: int) -> np.ndarray:
    """For each of ``n`` places the greatest value of the ranges ``lo`` to ``hi`` that hold it, or ``none``."""
    size = np.frexp(np.maximum(hi - lo, 0).astype(float))[1] - 1
    above = np.full(n, none)
    for k in range(int(size.max(initial=-1)), -1, -1):
        own = size == k
        np.maximum.at(above, lo[own], values[own])
        np.maximum.at(above, hi[own] - (1 << k), values[own])
        if k:  # a stretch of this length is two of half the length
            half = 1 << (k - 1)
            below = above.copy()
            below[half:] = np.maximum(below[half:], above[:-half])
            above = below
    return above


def range_kth(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th least (from 0) of ``ranks[lo:hi]``, bit by bit: what has a 0 comes before what has a 1."""
    found = np.zeros(len(lo), np.int64)
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        one = (ranks >> bit) & 1
        zeros = _upto(1 - one)
        a, b = zeros[lo], zeros[hi]
        up = k >= b - a
        k = np.where(up, k - (b - a), k)
        lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        found |= up.astype(np.int64) << bit
        ranks = np.concatenate([ranks[one == 0], ranks[one == 1]])
    return found


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _labels(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    coded = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _totals(calls: pa.Table, regions: pa.Table) -> pa.Table:
    s, e = _array(regions, "r_start"), _array(regions, "r_end")
    start, end, value = _array(calls, "l_start"), _array(calls, "l_end"), _array(calls, "value")
    labels, kind = _labels(calls, "label")
    none = np.iinfo(np.int64).min
    places, at = np.unique(s, return_inverse=True)
    parts = [(np.zeros(0, int),) * 5]
    for k in range(len(labels)):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(start[own], kind="stable")]
        a, b = start[own], np.sort(end[own])
        v = np.where(np.isnan(value[own]), none, np.nan_to_num(value[own])).astype(np.int64) if value.dtype.kind == "f" else value[own].astype(np.int64)
        sa, sb = _upto(a), _upto(b)

        def covered(x, a=a, b=b, sa=sa, sb=sb):  # bases of all calls before x
            i, j = np.searchsorted(a, x), np.searchsorted(b, x)
            return x * i - sa[i] - (x * j - sb[j])

        first, last = np.searchsorted(a, s), np.searchsorted(a, e)
        n = last - np.searchsorted(b, s, "right")
        over = covered_max(len(places), np.searchsorted(places, a, "right"), np.searchsorted(places, end[own]), v, none)
        most = np.maximum(range_max(v, first, last, none), over[at])
        hit = np.flatnonzero(n > 0)
        parts.append((hit, np.full(len(hit), k), n[hit], most[hit], (covered(e) - covered(s))[hit]))
    hit, k, n, most, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
    out = regions.drop_columns(["tile"]).take(pa.array(hit))
    more = {"label": labels.take(pa.array(k)), "n": pa.array(n, pa.int64()), "most": pa.array(most, pa.int64(), mask=most == none), "overlap_bp": pa.array(shared, pa.int64())}
    return pa.table({c: out[c] for c in out.column_names} | more)


def _medians(sites: pa.Table, regions: pa.Table) -> pa.Table:
    s, e = _array(regions, "r_start"), _array(regions, "r_end")
    labels, kind = _labels(sites, "label")
    pos, used, valid, modified, share = (_array(sites, c) for c in ("l_pos", "used", "valid", "modified", "share"))
    parts = [(np.zeros(0, int),) * 7]
    for k in range(len(labels)):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(pos[own], kind="stable")]
        lo, hi = np.searchsorted(pos[own], s), np.searchsorted(pos[own], e)
        total = lambda x, lo=lo, hi=hi: _upto(x)[hi] - _upto(x)[lo]
        known = own[~np.isnan(share[own])]
        a, b = np.searchsorted(pos[known], s), np.searchsorted(pos[known], e)
        values, ranks = np.unique(share[known], return_inverse=True)
        some = np.flatnonzero(b > a)
        middle = np.full(len(s), np.nan)
        if len(some):
            n = (b - a)[some]
            two = [values[range_kth(ranks, a[some], b[some], i)] for i in ((n - 1) // 2, n // 2)]
            middle[some] = two[0] + (two[1] - two[0]) * 0.5
        hit = np.flatnonzero(hi > lo)
        parts.append((hit, np.full(len(hit), k), (hi - lo)[hit], total(used[own].astype(np.int64))[hit], total(valid[own])[hit], total(modified[own])[hit], middle[hit]))
    hit, k, n, n_used, v, m, middle = (np.concatenate(x) for x in zip(*parts, strict=True))
    long = lambda x: pa.array(x, pa.int64())
    return pa.table({"target_id": regions["target_id"].combine_chunks().take(pa.array(hit)), "label": labels.take(pa.array(k)), "n_sites": long(n), "n_used": long(n_used), "valid": long(v), "modified": long(m), "median": pa.array(middle, pa.float64(), mask=np.isnan(middle))})


def _met(items: DataFrame, start: str, last: str, regions: DataFrame):
    """Both sides by contig and tile; ``last`` is the last base of an item that begins at ``start``."""
    items = items.where(f"l_chrom IS NOT NULL AND {start} <= {last}").withColumn("tile", F.explode(F.expr(f"sequence({start} div {TILE} - 1, ({last}) div {TILE})")))
    regions = regions.withColumn("tile", F.expr(f"r_start div {TILE}"))
    return items.groupBy("l_chrom", "tile").cogroup(regions.groupBy("r_chrom", "tile"))


def overlap_totals(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """The columns of ``regions(r_chrom, r_start, r_end, ...)`` with label, n, most and overlap_bp.

    ``calls(l_chrom, l_start, l_end, label, value)``; a row for each region and label with an overlapping call: their
    number, greatest value (a long) and sum of shared bases. No side is longer than a tile.
    """
    calls = calls.select("l_chrom", F.col("l_start").cast("long").alias("l_start"), F.col("l_end").cast("long").alias("l_end"), "label", F.col("value").cast("long").alias("value"))
    places = regions.where("r_start < r_end").withColumns({c: F.col(c).cast("long") for c in ("r_start", "r_end")})
    extra = [calls.schema["label"], *(StructField(c, LongType()) for c in ("n", "most", "overlap_bp"))]
    return _met(calls, "l_start", "l_end - 1", places).applyInArrow(_totals, StructType(places.schema.fields + extra))


def region_medians(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """(target_id, label, n_sites, n_used, valid, modified, median) of each region and label with a site.

    ``sites(l_chrom, l_pos, label, used, valid, modified, share)``: sums over all sites, the exact median of the
    shares that are not null. ``regions(r_chrom, r_start, r_end, target_id)``, none longer than a tile.
    """
    kind, label = regions.schema["target_id"].dataType.simpleString(), sites.schema["label"].dataType.simpleString()
    sites = sites.withColumns({"l_pos": F.col("l_pos").cast("long"), "valid": F.col("valid").cast("long"), "modified": F.col("modified").cast("long"), "share": F.coalesce(F.col("share").cast("double"), F.lit(float("nan")))})
    schema = f"target_id {kind}, label {label}, n_sites long, n_used long, valid long, modified long, median double"
    return _met(sites, "l_pos", "l_pos", regions.where("r_start < r_end")).applyInArrow(_medians, schema)

