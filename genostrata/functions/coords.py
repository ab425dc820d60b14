"""Genomic coordinates as columns: 0-based half-open inside, canonical ``chr`` names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AUTOSOMES = [str(i) for i in range(1, 23)]


def bare(contig: Column) -> Column:
    """The name without a ``chr`` prefix, upper-cased."""
    return F.upper(F.regexp_replace(F.trim(contig), "(?i)^chr", ""))


def normalize_contig(contig: Column) -> Column:
    """``chrN`` for 1-22, X, Y and the mitochondrion; other names unchanged, empty ones null."""
    name = bare(contig)
    return F.when(F.trim(contig) == "", None).when(name.isin(*_AUTOSOMES, "X", "Y"), F.concat(F.lit("chr"), name)).when(name.isin("M", "MT"), "chrM").otherwise(F.trim(contig))


def contig_rank(contig: Column, *, mitochondrion: int = 99, other: int = 99) -> Column:
    """Natural order: 1-22, X 23, Y 24, then ``mitochondrion`` and ``other``."""
    name = bare(contig)
    return F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), mitochondrion).otherwise(F.coalesce(name.try_cast("int"), F.lit(other)))


#: What must be added to the start of each input system; a position is one base.
SYSTEMS = {"zero_based_half_open": 0, "one_based_inclusive": -1, "one_based_position": -1}
#: The system of each source format.
FORMATS = {"bed": "zero_based_half_open", "gtf": "one_based_inclusive", "gff3": "one_based_inclusive", "vcf": "one_based_position", "region": "one_based_inclusive"}


def normalize_interval(start: Column, end: Column, system: str) -> Column:
    """struct(start, end, conversion, error) in 0-based half-open coordinates."""
    if system not in SYSTEMS:
        raise ValueError(f"unknown coordinate system {system!r}")
    first = start + F.lit(SYSTEMS[system])
    last = start if system == "one_based_position" else end
    error = F.when(first.isNull() | last.isNull(), "missing_coordinate").when(first < 0, "negative_start").when(last <= first, "empty_interval")
    conversion = "unchanged" if SYSTEMS[system] == 0 else "start_minus_one"
    return F.struct(first.alias("start"), last.alias("end"), F.lit(conversion).alias("conversion"), error.alias("error"))


def from_format(start: Column, end: Column, source_format: str) -> Column:
    return normalize_interval(start, end, FORMATS[source_format])


def locus_text(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def overlap_bp(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def reciprocal_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The smaller of the two covered shares; 0 without overlap."""
    shared = overlap_bp(a_start, a_end, b_start, b_end)
    return F.when(shared == 0, 0.0).otherwise(F.least(shared / (a_end - a_start), shared / (b_end - b_start)))


def locus_distance(a_chrom: Column, a_start: Column, a_end: Column, b_chrom: Column, b_start: Column, b_end: Column) -> Column:
    """The larger of the distances of starts and ends; null on different contigs."""
    return F.when(bare(a_chrom) == bare(b_chrom), F.greatest(F.abs(a_start - b_start), F.abs(a_end - b_end)))


def length_ratio_difference(a: Column, b: Column) -> Column:
    """abs(a - b) / max(a, b); 0 if a length is unknown."""
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.abs(a - b) / F.greatest(a, b))


def ordered_pair(first: Column, second: Column) -> Column:
    """Two structs (rank, start, end) with the lesser locus first, and whether they were swapped."""
    return F.struct(F.least(first, second).alias("left"), F.greatest(first, second).alias("right"), (second < first).alias("swapped"))


def normalize_orientation(text: Column) -> Column:
    """``++``, ``+-``, ``-+`` or ``--`` without slashes and blanks, else null."""
    plain = F.regexp_replace(text, r"[/\s]", "")
    return F.when(plain.isin("++", "+-", "-+", "--"), plain)


def orientation_set(strands: Column, swapped: Column) -> Column:
    """Distinct orientations of an array, each reversed if the pair was swapped."""
    turned = F.transform(strands, lambda s: F.when(swapped & (F.length(s) == 2), F.reverse(s)).otherwise(s))
    return F.array_distinct(F.filter(turned, lambda s: s.isNotNull()))


def contig_signature(contigs: DataFrame) -> DataFrame:
    """One row: n_contigs and the SHA-256 of ``name<TAB>length<LF>`` in order (ord, chrom, length)."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "chrom", "length")))
    lines = F.array_join(F.transform(rows, lambda r: F.concat(r["chrom"], F.lit("\t"), r["length"].cast("string"), F.lit("\n"))), "")
    return contigs.agg(F.count(F.lit(1)).alias("n_contigs"), F.sha2(lines, 256).alias("signature"))
