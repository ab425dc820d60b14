"""Variant files as tables: every record is kept, with the first reason it cannot be used.

Readers take lines (one column ``value``), so ``spark.read.text`` of plain or gzipped files
and any stream of lines will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genostrata.functions.evidence import first_reason

MAX_POS = 2**31 - 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def records(text: DataFrame) -> DataFrame:
    """Columns of record lines as ``c`` (array); headers and empty lines are left out."""
    # Not a filter on ``value``: one would be pushed below, where a made line is made again for each condition.
    keep = (F.trim("value") != "") & ~F.startswith("value", F.lit("#"))
    return text.select(F.explode(F.array(F.when(keep, F.split("value", "\t")))).alias("c")).where("c IS NOT NULL")


def field(i: int) -> Column:
    return F.get("c", F.lit(i))


def _items(text: Column) -> Column:
    """The items of ``k=v;flag`` as structs of key and value, flags with null values; ``.`` is empty."""
    items = F.filter(F.split(text, ";"), lambda x: (x != "") & (x != "."))
    return F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, F.lit("=")) + 1)).alias("value")))


def _map_of(pairs: Column) -> Column:
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    alone = F.size(F.array_distinct(pairs["key"])) == F.size(pairs)
    return F.map_from_entries(F.when(alone, pairs).otherwise(last))


def info_map(text: Column) -> Column:
    """``k=v;flag`` as a map, flags with null values; ``.`` is empty. The last of equal keys wins."""
    return _map_of(_items(text))


def with_info(rows: DataFrame, i: int = 7) -> DataFrame:
    """``rows`` with the map of field ``i`` as ``info``; the field is cut once, however often the items are asked for."""
    return rows.withColumn("items", F.when(~malformed_info(field(i)), _items(field(i)))).withColumn("info", _map_of(F.col("items"))).drop("items")


def malformed_info(text: Column) -> Column:
    """An item without a key, as in ``;=3;``."""
    return F.contains(F.concat(F.lit(";"), text), F.lit(";="))


def sample_map(names: Column, values: Column) -> Column:
    """FORMAT names with the sample's values, cut to the shorter of the two."""
    a, b = F.split(names, ":"), F.split(values, ":")
    n = F.least(F.size(a), F.size(b))
    return F.map_from_arrays(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def number(text: Column, *, minimum: float | None = None) -> Column:
    """The first of comma-joined numbers; null if missing, not finite or below ``minimum``."""
    return _finite(_read(text), minimum)


def _read(text: Column) -> Column:
    return F.nullif(F.substring_index(text, ",", 1), F.lit(".")).try_cast("double")


def _finite(value: Column, minimum: float | None = None) -> Column:
    """``value`` if it is finite and not below ``minimum``: not a number stands above infinity."""
    least = value > float("-inf") if minimum is None else value >= minimum
    return F.when(least & (value < float("inf")), value)


def _with_numbers(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``rows`` with the number of each text by name; each text is read once, however often its number is asked for."""
    read = rows.withColumn("numbers", F.transform(F.array(*texts.values()), lambda x: _read(x)))
    read = read.withColumn("numbers", F.transform("numbers", lambda x: _finite(x)))
    return read.withColumns({name: F.col("numbers")[i] for i, name in enumerate(texts)})


_LOCAL_FIRST = r"^([ACGTNacgtn]+)([\[\]])([^\[\]:\s]+):(\d+)([\[\]])$"
_MATE_FIRST = r"^([\[\]])([^\[\]:\s]+):(\d+)([\[\]])([ACGTNacgtn]+)$"


def breakend(alt: Column) -> Column:
    """struct(mate_chrom, mate_pos (0-based), form, error) of a bracketed allele."""
    local = alt.rlike(_LOCAL_FIRST) & (F.regexp_extract(alt, _LOCAL_FIRST, 2) == F.regexp_extract(alt, _LOCAL_FIRST, 5))
    mate = alt.rlike(_MATE_FIRST) & (F.regexp_extract(alt, _MATE_FIRST, 1) == F.regexp_extract(alt, _MATE_FIRST, 4))
    chrom = F.when(local, F.regexp_extract(alt, _LOCAL_FIRST, 3)).when(mate, F.regexp_extract(alt, _MATE_FIRST, 2))
    pos = F.when(local, F.regexp_extract(alt, _LOCAL_FIRST, 4)).when(mate, F.regexp_extract(alt, _MATE_FIRST, 3)).try_cast("long")
    ok = F.coalesce((pos >= 1) & (pos <= MAX_POS), F.lit(False))
    opened = F.contains(alt, F.lit("["))
    form = F.when(local & opened, "t[p[").when(local, "t]p]").when(mate & opened, "[p[t").when(mate, "]p]t")
    return F.struct(F.when(ok, chrom).alias("mate_chrom"), F.when(ok, pos - 1).alias("mate_pos"), F.when(ok, form).alias("form"), F.when(~ok, "malformed_breakend_alt").alias("error"))


def _no_mate() -> Column:
    """What ``breakend`` gives for an allele without a bracket."""
    return F.struct(F.lit(None).cast("string").alias("mate_chrom"), F.lit(None).cast("long").alias("mate_pos"), F.lit(None).cast("string").alias("form"), F.lit("malformed_breakend_alt").alias("error"))


def small_variants(text: DataFrame) -> DataFrame:
    """Germline records of one sample: chrom, pos, ref, alt, depth, variant_reads, quality, filter, reason.

    reason is null for a usable record. Reasons in order: malformed_no_format,
    malformed_multi_allelic, malformed_missing_depth, malformed_missing_allele_depth,
    malformed_unparsable_counts, malformed_zero_depth, malformed_inconsistent_counts.
    """
    r = records(text).withColumn("s", F.when(F.size("c") >= 10, sample_map(field(8), field(9))))
    depth, ad = F.col("s")["DP"], F.split(F.col("s")["AD"], ",")
    reads = F.get(ad, F.size(ad) - 1).try_cast("int")
    quality = F.when(field(5) == ".", 0.0).otherwise(field(5).try_cast("double"))
    d, pos = depth.try_cast("int"), field(1).try_cast("long")
    reason = first_reason([
        ("malformed_no_format", F.size("c") < 10),
        ("malformed_multi_allelic", F.contains(field(4), F.lit(","))),
        ("malformed_missing_depth", depth.isNull()),
        ("malformed_missing_allele_depth", F.col("s")["AD"].isNull()),
        ("malformed_unparsable_counts", d.isNull() | reads.isNull() | quality.isNull() | pos.isNull()),
        ("malformed_zero_depth", d <= 0),
        ("malformed_inconsistent_counts", reads > d),
    ])
    return r.select(field(0).alias("chrom"), pos.alias("pos"), field(3).alias("ref"), field(4).alias("alt"), d.alias("depth"), F.greatest(F.lit(0), reads).alias("variant_reads"), quality.alias("quality"), field(6).alias("filter"), reason.alias("reason"))


def variant_class(ref: Column, alt: Column) -> Column:
    n, m = F.length(ref), F.length(alt)
    return F.when((n == 1) & (m == 1), "SNV").when(n == m, "MNV").when((n < m) & F.startswith(alt, ref), "INS").when((n > m) & F.startswith(ref, alt), "DEL").otherwise("COMPLEX")


def allele_rows(text: DataFrame) -> DataFrame:
    """Somatic records, one row for each alternate allele: fraction of all allele reads and class."""
    r = records(text).withColumn("s", sample_map(field(8), field(9)))
    alts = r.select("*", F.posexplode(F.split(field(4), ",")).alias("i", "alt"))
    ad = F.transform(F.split(F.col("s")["AD"], ","), lambda x: x.try_cast("int"))
    total = F.aggregate(ad, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    alt_reads = F.get(ad, F.col("i") + 1)
    return alts.select(field(0).alias("chrom"), field(1).try_cast("long").alias("pos"), field(3).alias("ref"), "alt", alt_reads.alias("alt_reads"), F.try_divide(alt_reads, total).alias("fraction"), variant_class(field(3), F.col("alt")).alias("class"), (field(6) == "PASS").alias("technical_pass"))


SV_TYPES = {"DEL": "deletion", "DUP": "duplication", "INV": "inversion", "INS": "insertion", "BND": "translocation", "TRA": "translocation"}


def structural_variants(text: DataFrame, *, min_support: int = 5, min_length: int = 50, pass_only: bool = True, support_keys: tuple[str, ...] = ("SUPPORT", "RE"), fraction_keys: tuple[str, ...] = ("VAF",), min_fraction: float = 0.0, only_class: str | None = None, allowed: tuple[str, ...] | None = None, min_quality: float | None = None, require_precise: bool = False) -> DataFrame:
    """Structural-variant records in 0-based half-open coordinates, each with its first reason.

    Support comes from the first of ``support_keys`` in INFO, else from DV in FORMAT; the
    fraction from ``fraction_keys``, else DV / (DR + DV). An insertion spans one base; a
    translocation has a mate and no length. The type is what stands before a colon in
    SVTYPE. With ``only_class`` a record of another CLASS is rejected; one without stays.
    ``allowed`` event types, ``min_quality`` and ``require_precise`` are asked for only where
    given. What a record says of coverage, fraction, strands, mismatches and deviations must
    be well formed, and it cannot be both precise and imprecise.
    """
    keys = dict.fromkeys(("SVTYPE", "END", "SVLEN", "CLASS", "COVERAGE", "STRAND", "NM", "STDEV_POS", "STDEV_LEN", *support_keys, *fraction_keys))
    # What is asked for more than once is a column, or each asking would work it out anew.
    r = with_info(records(text)).withColumns({"s": sample_map(field(8), field(9)), "mate": F.when(field(4).rlike(r"[\[\]]"), breakend(field(4))).otherwise(_no_mate())})
    r = r.withColumns({f"info_{k}": F.col("info")[k] for k in keys} | {f"has_{k}": F.map_contains_key("info", k) for k in ("PRECISE", "IMPRECISE")} | {"qual": field(5), "position": field(1).try_cast("long")})
    info = {k: F.col(f"info_{k}") for k in keys}
    numbers = {f"n_{k}": info[k] for k in ("SVLEN", "NM", "STDEV_POS", "STDEV_LEN", *support_keys, *fraction_keys)}
    r = _with_numbers(r, numbers | {"n_quality": F.col("qual"), "n_DV": F.col("s")["DV"], "n_DR": F.col("s")["DR"]})
    positive = lambda k: F.when(F.col(f"n_{k}") >= 0, F.col(f"n_{k}"))
    told = lambda c: F.nullif(c, F.lit("."))  # noqa: E731  what is given, if anything
    bad = lambda c, k: told(c).isNotNull() & positive(k).isNull()
    svlen = F.abs("n_SVLEN").cast("long")
    pos, start = F.col("position"), F.col("position") - 1
    dv, dr = positive("DV"), positive("DR")
    r = r.withColumns({
        "kind": F.create_map(*[F.lit(x) for kv in SV_TYPES.items() for x in kv])[F.upper(F.substring_index(info["SVTYPE"], ":", 1))],
        "end": F.coalesce(info["END"].try_cast("long"), start + svlen),
        "support": F.coalesce(*[positive(k) for k in support_keys], dv).cast("int"),
        "fraction": F.coalesce(*[positive(k) for k in fraction_keys], F.try_divide(dv, dv + dr)),
        "quality": positive("quality"),
        "depths": F.transform(F.filter(F.split(told(info["COVERAGE"]), ","), lambda x: ~x.isin("", ".")), lambda x: number(x, minimum=0)),
    })
    kind, support, fraction, mate, quality, depths = map(F.col, ("kind", "support", "fraction", "mate", "quality", "depths"))
    r = r.withColumn("last", F.when(kind.isin("insertion", "translocation"), start + 1).otherwise(F.col("end")))
    last = F.col("last")
    length = F.when(kind == "translocation", F.lit(None).cast("long")).when(kind == "insertion", svlen).otherwise(last - start)
    has = lambda k: F.coalesce(F.col(f"has_{k}"), F.lit(False))
    bad_depths = F.coalesce(F.exists(depths, lambda x: x.isNull()), F.lit(False))
    reason = first_reason([
        ("malformed_record", F.size("c") < 8),
        ("malformed_position", F.coalesce((pos < 1) | (pos > MAX_POS), F.lit(True))),
        ("filter_not_pass", F.lit(pass_only) & ~field(6).isin("PASS", ".")),
        ("malformed_info", malformed_info(field(7))),
        ("missing_type", info["SVTYPE"].isNull()),
        ("unsupported_type", kind.isNull()),
        ("type_not_allowed", F.lit(False) if allowed is None else ~kind.isin(*allowed)),
        ("class_not_accepted", F.lit(False) if only_class is None else F.coalesce(info["CLASS"] != only_class, F.lit(False))),
        ("low_support", F.coalesce(support < min_support, F.lit(min_support > 0))),
        ("malformed_quality", bad(F.col("qual"), "quality")),
        ("missing_quality", F.lit(min_quality is not None) & quality.isNull()),
        ("low_quality", F.lit(False) if min_quality is None else F.coalesce(quality < min_quality, F.lit(False))),
        ("imprecise", F.lit(require_precise) & ~has("PRECISE")),
        ("low_fraction", F.coalesce(fraction < min_fraction, F.lit(min_fraction > 0))),
        ("malformed_breakend_alt", (kind == "translocation") & mate["error"].isNotNull()),
        ("malformed_locus", F.coalesce(last <= start, F.lit(True))),
        ("too_short", length < min_length),
        ("malformed_coverage", bad_depths),
        ("malformed_fraction", reduce(Column.__or__, [bad(info[k], k) for k in fraction_keys])),
        ("invalid_fraction", F.coalesce(fraction > 1, F.lit(False))),
        ("malformed_strands", F.coalesce(~told(info["STRAND"]).isin("+", "-", "+-"), F.lit(False))),
        ("malformed_mismatches", bad(info["NM"], "NM")),
        ("malformed_deviation", bad(info["STDEV_POS"], "STDEV_POS") | bad(info["STDEV_LEN"], "STDEV_LEN")),
        ("conflicting_precision", has("PRECISE") & has("IMPRECISE")),
    ])
    return r.select(field(2).alias("record_id"), field(0).alias("chrom"), start.alias("start_pos"), last.alias("end_pos"), kind.alias("event_type"), length.alias("length"), support.alias("support_reads"), fraction.alias("vaf"), mate["mate_chrom"].alias("mate_chrom"), mate["mate_pos"].alias("mate_pos"), F.col("has_PRECISE").alias("precise"), quality.alias("quality"), F.when(F.size(depths) > 0, F.aggregate(depths, F.lit(0.0), lambda a, x: a + x) / F.size(depths)).alias("local_coverage"), told(info["STRAND"]).alias("supporting_strands"), reason.alias("reason"))


def depth_segments(text: DataFrame, *, min_length: int = 100_000, pass_only: bool = True) -> DataFrame:
    """Depth-based copy-number records of one sample, each with its first reason.

    POS of these files is 0-based already and SVLEN equals END - POS. The allele names the
    type or is ``.``; copy_number is CN of INFO where given.
    """
    r = with_info(records(text))
    r = r.withColumns({f"info_{k}": F.col("info")[k] for k in ("SVTYPE", "END", "SVLEN", "CN")})
    info = {k: F.col(f"info_{k}") for k in ("SVTYPE", "END", "SVLEN", "CN")}
    r = r.withColumns({"raw": F.upper(info["SVTYPE"]), "start": field(1).try_cast("long"), "end": info["END"].try_cast("long"), "svlen": info["SVLEN"].try_cast("long"), "cn": info["CN"].try_cast("double")})
    raw, start, end, svlen, cn = map(F.col, ("raw", "start", "end", "svlen", "cn"))
    kind = F.when(raw == "DEL", "deletion").when(raw == "DUP", "duplication")
    reason = first_reason([
        ("malformed_record", F.size("c") != 10),
        ("malformed_start", F.coalesce(start < 0, F.lit(True))),
        ("malformed_filter", field(6) == ""),
        ("filter_not_pass", F.lit(pass_only) & ~field(6).isin(".", "PASS")),
        ("malformed_info", malformed_info(field(7))),
        ("missing_svtype", info["SVTYPE"].isNull()),
        ("unsupported_svtype", kind.isNull()),
        ("svtype_alt_mismatch", (field(4) != ".") & (field(4) != F.concat(F.lit("<"), raw, F.lit(">")))),
        ("missing_or_invalid_end", end.isNull()),
        ("invalid_native_interval", end <= start),
        ("missing_or_invalid_svlen", svlen.isNull()),
        ("native_length_mismatch", svlen != end - start),
        ("cnv_length_below_policy", svlen < min_length),
        ("invalid_copy_number", info["CN"].isNotNull() & F.coalesce(cn < 0, F.lit(True))),
    ])
    return r.select(field(2).alias("record_id"), field(0).alias("chrom"), start.alias("start_pos"), end.alias("end_pos"), kind.alias("event_type"), svlen.alias("length"), cn.alias("copy_number"), number(field(5), minimum=0).alias("quality"), reason.alias("reason"))


def reasons(rows: DataFrame) -> DataFrame:
    """(reason, n), usable records under ``accepted``."""
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
