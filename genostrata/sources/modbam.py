"""Modified bases of aligned reads, from the text of alignment files.

Columns and tags are split by built-ins; the walk over a read's deltas, probabilities and
CIGAR is an Arrow function, one pass over each line. Any line that breaks the format, or
that belongs to kinds of reads that are not taken here, fails the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.functions.coords import normalize_contig
from genostrata.sources.tables import checked, interval_state

#: Unmapped, secondary and supplementary alignments are left out.
EXCLUDED_FLAGS = 0x904
REVERSE, PAIRED = 0x10, 0x1
MOST_BASES = 2_000_000

_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_GROUP = re.compile(r"([ACGTUN])([+-])([a-z]+|\d+)([.?]?)((?:,\d+)*);")
_BASES = re.compile("[ACGTRYKMSWBDHVN]+")
_COMPLEMENT = str.maketrans("ACGTRYKMBDHV", "TGCAYRMKVHDB")
_CLIPS = re.compile(r"(?:\d+H)?(?:\d+S)?(?:\d+[MIDN=X])*(?:\d+S)?(?:\d+H)?")


def _tag(name: str, kind: str) -> tuple[Column, Column]:
    """Whether a tag stands at most once and as ``kind``, and its text."""
    tags = F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0)))
    mine = F.filter(tags, lambda t: F.startswith(t, F.lit(f"{name}:")))
    first = F.get(mine, F.lit(0))
    fits = (F.size(mine) == 0) | ((F.size(mine) == 1) & F.startswith(first, F.lit(f"{name}:{kind}")))
    return fits, F.substr(first, F.lit(len(f"{name}:{kind}") + 1))


def alignments(text: DataFrame) -> DataFrame:
    """read_name, flag, contig, start_pos (0-based), cigar, seq, mm, ml, mn, dx of each alignment line.

    Header lines, unmapped, secondary and supplementary alignments are left out. Paired
    reads, a read with two primary alignments, duplex reads, tags of wrong type or standing
    twice and old-style Mm/Ml tags fail the whole.
    """
    r = text.where("trim(value) <> '' AND NOT startswith(value, '@')").select(F.split("value", "\t").alias("c"))
    r = checked(r, F.size("c") >= 11, "alignment line has fewer than eleven fields")
    old = F.exists("c", lambda t: F.startswith(t, F.lit("Mm:")) | F.startswith(t, F.lit("Ml:")))
    r = checked(r, ~old, "old-style Mm or Ml tag")
    tags = {"mm": _tag("MM", "Z:"), "ml": _tag("ML", "B:C"), "mn": _tag("MN", "i:"), "dx": _tag("dx", "i:")}
    for name, (fits, _) in tags.items():
        r = checked(r, fits, f"tag {name} is repeated or of wrong type")
    at = lambda i: F.get("c", F.lit(i))
    number = lambda c: c.try_cast("long")
    r = r.select(at(0).alias("read_name"), number(at(1)).alias("flag"), at(2).alias("contig"), (number(at(3)) - 1).alias("start_pos"), at(5).alias("cigar"), F.upper(at(9)).alias("seq"), tags["mm"][1].alias("mm"), tags["ml"][1].alias("ml"), tags["mn"][1].alias("mn"), tags["dx"][1].alias("dx"))
    r = checked(r, F.col("flag").between(0, 65535) & F.col("start_pos").isNotNull(), "flag or position is no number in range")
    r = r.where(F.col("flag").bitwiseAND(F.lit(EXCLUDED_FLAGS)) == 0)
    r = checked(r, F.col("flag").bitwiseAND(F.lit(PAIRED)) == 0, "paired alignment")
    r = checked(r, F.col("read_name").isNotNull() & ~F.col("read_name").isin("", "*"), "alignment without a read name")
    r = checked(r, F.coalesce(F.col("dx"), F.lit("0")).isin("0", "-1"), "duplex read, or dx out of range")
    each = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("read_name")))
    return checked(each, F.col("n") == 1, "a read has two primary alignments").drop("n", "dx")


def reference_places(cigar: str, start: int, length: int, mn: str | None) -> np.ndarray:
    """The reference position of each base of the query, -1 for inserted and clipped ones."""
    parts = [(int(n), op) for n, op in _CIGAR.findall(cigar)]
    if not parts or "".join(f"{n}{op}" for n, op in parts) != cigar or any(n < 1 for n, _ in parts) or start < 0:
        raise ValueError("invalid CIGAR or position")
    if any(op == "P" for _, op in parts) or not _CLIPS.fullmatch(cigar):
        raise ValueError("padding or clipping inside the CIGAR")
    if mn is not None and mn != str(length):
        raise ValueError("MN differs from the length of the sequence")
    if mn is None and any(op == "H" for _, op in parts):
        raise ValueError("a hard-clipped read needs MN")
    pieces, at = [], start
    for n, op in parts:
        if op in "M=X":
            pieces.append(np.arange(at, at + n))
        elif op in "IS":
            pieces.append(np.full(n, -1))
        at += n if op in "MDN=X" else 0
    places = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
    if len(places) != length:
        raise ValueError("CIGAR and sequence differ in length")
    return places


def cytosines(flag: int, start: int, cigar: str, seq: str, mm: str | None, ml: str | None, mn: str | None, codes: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cytosine in the read as it was sequenced: its place, its reference position, its bytes by code.

    The position is -1 off the reference, a byte -1 where the tags say nothing of it: what
    they leave out is unknown, whatever flag they carry.
    """
    if not seq or seq == "*" or len(seq) > MOST_BASES or not _BASES.fullmatch(seq):
        raise ValueError("sequence is missing, too long or no DNA")
    places = reference_places(cigar, start, len(seq), mn)
    if flag & REVERSE:
        seq, places = seq.translate(_COMPLEMENT)[::-1], places[::-1]
    if mm is None or ml is None:
        raise ValueError("MM or ML tag is missing")
    if ml and not re.fullmatch(r"(?:,\d{1,3})+", ml):
        raise ValueError("ML is no list of bytes")
    values = np.array(ml[1:].split(",") if ml else [], np.int64)
    if (values > 255).any():
        raise ValueError("ML is no list of bytes")
    groups = list(_GROUP.finditer(mm))
    if not groups or "".join(g[0] for g in groups) != mm:
        raise ValueError("MM does not follow its grammar")
    letters = np.frombuffer(seq.encode(), np.uint8)
    own = np.flatnonzero(letters == ord("C"))
    found = np.full((len(own), len(codes)), -1, np.int64)
    declared, used = set(), 0
    for base, strand, listed, _, deltas in (g.groups() for g in groups):
        if strand != "+" or base in "NU":
            raise ValueError("opposite-strand, wildcard or RNA group in MM")
        here = list(listed) if listed.isalpha() else [listed]
        if base == "C" and set(here) - set(codes):
            raise ValueError("MM contradicts the declared modifications")
        if any((base, c) in declared for c in here) or len(set(here)) != len(here):
            raise ValueError("MM repeats a modification")
        declared |= {(base, c) for c in here}
        steps = np.array(deltas[1:].split(",") if deltas else [], np.int64)
        nth = np.cumsum(steps + 1) - 1
        most = len(own) if base == "C" else int((letters == ord(base)).sum())
        if len(nth) and nth[-1] >= most:
            raise ValueError("MM leads beyond the sequence")
        mine = values[used : used + len(nth) * len(here)]
        if len(mine) != len(nth) * len(here):
            raise ValueError("ML and MM differ in length")
        used += len(mine)
        if base == "C" and len(nth):
            found[np.ix_(nth, [codes.index(c) for c in here])] = mine.reshape(len(nth), len(here))
    if used != len(values):
        raise ValueError("ML and MM differ in length")
    if {c for base, c in declared if base == "C"} != set(codes):
        raise ValueError("MM contradicts the declared modifications")
    return own, places[own], found


def read_cytosines(text: DataFrame, codes: tuple[str, ...] = ("m", "h")) -> DataFrame:
    """read_name, chrom, pos, strand, read_pos, ml (a byte or null by code) of each aligned cytosine.

    ``text(value)`` holds alignment lines; pos is 0-based on the contig, read_pos counts from
    the start of the read as it was sequenced. Reads on other than canonical contigs are
    left out, but checked like others.
    """
    rows = alignments(text).withColumn("chrom", normalize_contig(F.col("contig")))
    inputs = ("flag", "start_pos", "cigar", "seq", "mm", "ml", "mn")
    names = ["read_name", "chrom", "pos", "strand", "read_pos", "ml"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, strand, pos, place, told = [], [], [], [], []
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)):
                own, at, found = cytosines(*values, codes)
                aligned = at >= 0
                n = int(aligned.sum())
                row.append(np.full(n, i))
                strand += ["-" if values[0] & REVERSE else "+"] * n
                pos.append(at[aligned])
                place.append(own[aligned])
                told.append(found[aligned])
            if strand:
                which, told = pa.array(np.concatenate(row)), np.concatenate(told).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(told) + 1, len(codes)), pa.int32()), pa.array(told, pa.int32(), mask=told < 0))
                columns = [batch.column("read_name").take(which), batch.column("chrom").take(which), pa.array(np.concatenate(pos)), pa.array(strand), pa.array(np.concatenate(place)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = rows.select("read_name", "chrom", *inputs).mapInArrow(run, "read_name string, chrom string, pos bigint, strand string, read_pos bigint, ml array<int>")
    return found.where(F.col("chrom").rlike("^chr([0-9]+|X|Y|M)$"))


def byte_interval(byte: Column) -> Column:
    """struct(low, high): the 256th that a stored byte stands for."""
    return F.when(byte.isNotNull(), F.struct((byte / 256).alias("low"), ((byte + 1) / 256).alias("high")))


def modified_bases(text: DataFrame, codes: tuple[str, ...] = ("m", "h")) -> DataFrame:
    """read_name, chrom, pos, strand, read_pos, code, low, high: what is said of each aligned cytosine."""
    each = read_cytosines(text, codes).select("read_name", "chrom", "pos", "strand", "read_pos", F.posexplode("ml").alias("i", "byte")).where("byte IS NOT NULL")
    code = F.get(F.array(*map(F.lit, codes)), "i")
    return each.select("read_name", "chrom", "pos", "strand", "read_pos", code.alias("code"), byte_interval(F.col("byte"))["low"].alias("low"), byte_interval(F.col("byte"))["high"].alias("high"))


def cpg_sites(sequences: DataFrame) -> DataFrame:
    """chrom, pos, strand of the cytosines of CG in ``sequences(chrom, start_pos, sequence)``.

    Pieces of a contig overlap by one base, so that no pair is cut.
    """
    pair = lambda i: F.substr(F.upper("sequence"), i + 1, F.lit(2)) == "CG"
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length("sequence") - 2, F.lit(0))), pair)
    found = sequences.select("chrom", "start_pos", F.explode(starts).alias("i"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("shift"), F.lit("+").alias("strand")), F.struct(F.lit(1).alias("shift"), F.lit("-").alias("strand"))))
    found = found.select("chrom", (F.col("start_pos") + F.col("i")).alias("start"), both.alias("b"))
    return found.select("chrom", (F.col("start") + F.col("b.shift")).alias("pos"), "b.strand").distinct()


def modified_calls(text: DataFrame, sites: DataFrame, codes: tuple[str, ...] = ("m", "h"), *, threshold: float = 0.8) -> DataFrame:
    """read_name, chrom, pos, strand, state (M, U or A) of the cytosines on ``sites(chrom, pos, strand)``.

    Where the tags say nothing of a code the state is ambiguous.
    """
    told = [F.struct(F.lit(c).alias("code"), byte_interval(F.get("ml", F.lit(i))).alias("x")) for i, c in enumerate(codes)]
    known = F.map_from_entries(F.filter(F.array(*told), lambda t: t["x"].isNotNull()))
    on_site = read_cytosines(text, codes).join(sites.select("chrom", "pos", "strand").distinct(), ["chrom", "pos", "strand"])
    return on_site.select("read_name", "chrom", "pos", "strand", interval_state(known, list(codes), threshold).alias("state"))
