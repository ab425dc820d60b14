"""Region, methylation, annotation and run files as tables.

Files that must be whole or not at all are checked with ``require``: its query returns
the broken lines, and ``checked`` raises on the first of them while the rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.functions.coords import normalize_contig
from genostrata.functions.text import percent_decode


def _rows(text: DataFrame, separator: str = "\t") -> DataFrame:
    return text.where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.split("value", separator).alias("c"))


def col(i: int) -> Column:
    return F.get("c", F.lit(i))


def checked(rows: DataFrame, condition: Column, what: str) -> DataFrame:
    """``rows``, raising at the first that does not meet ``condition``.

    The draw tells the planner that the check is not to be joined with other filters: taken
    for a plain condition, it is also evaluated on rows that a later filter leaves out, with
    that filter's constants put in. As a column of the rows it also keeps the check where it
    stands: below the columns that it reads, each check would work them out anew.
    """
    fails = ~F.coalesce(condition, F.lit(False)) & (F.col("__draw") >= 0)
    drawn = rows.withColumn("__draw", F.rand(0))
    return drawn.where(F.when(fails, F.raise_error(F.lit(what)).cast("boolean")).otherwise(True)).drop("__draw")


def target_bed(text: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, region_id of a target file; any bad line fails the whole."""
    r = _rows(text).select(normalize_contig(col(0)).alias("chrom"), col(1).try_cast("long").alias("start_pos"), col(2).try_cast("long").alias("end_pos"), col(3).alias("name"))
    r = checked(r, F.col("chrom").rlike("^chr([0-9]+|X|Y)$") & (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")), "malformed target line")
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat_ws("-", F.concat_ws(":", "chrom", F.col("start_pos").cast("string")), F.col("end_pos").cast("string")))
    return r.select("chrom", "start_pos", "end_pos", name.alias("region_id"))


def interval_bed(text: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, label, value of an annotation file."""
    return _rows(text).select(normalize_contig(col(0)).alias("chrom"), col(1).cast("long").alias("start_pos"), col(2).cast("long").alias("end_pos"), col(3).alias("label"), col(4).try_cast("double").alias("value"))


def context_bed(text: DataFrame, resource: str) -> DataFrame:
    """chrom, start_pos, end_pos, label of a context file; lines without a name have ``resource`` as label.

    Header, track and browser lines are left out; a line without a valid span fails the whole.
    """
    r = text.where(F.col("value") != "").where(~F.col("value").rlike("^(#|track|browser)")).select(F.split("value", "\t").alias("c"))
    r = r.select(normalize_contig(col(0)).alias("chrom"), col(1).try_cast("long").alias("start_pos"), col(2).try_cast("long").alias("end_pos"), F.coalesce(F.nullif(F.trim(col(3)), F.lit("")), F.lit(resource)).alias("label"))
    return checked(r, (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")), "malformed context line")


def bedmethyl(text: DataFrame) -> DataFrame:
    """The 18 columns of a pileup; counts that do not add up fail the whole."""
    names = ["mod", "canon", "other", "del", "fail", "diff", "nocall"]
    r = _rows(text, r"\s+").select(normalize_contig(col(0)).alias("chrom"), col(1).try_cast("long").alias("pos"), col(3).alias("code"), col(5).alias("strand"), col(9).try_cast("int").alias("valid"), col(10).try_cast("double").alias("percent"), *[col(11 + i).try_cast("int").alias(f"n_{x}") for i, x in enumerate(names)])
    r = checked(r, F.col("code").isin("m", "h", "a", "C"), "unknown modification code")
    return checked(r, F.col("valid") == F.col("n_mod") + F.col("n_canon") + F.col("n_other"), "valid coverage is not the sum of its parts")


#: By how much a stated percentage may differ from its counts.
PERCENT_TOLERANCE = 0.011


def combined_bedmethyl(text: DataFrame) -> DataFrame:
    """chrom, pos, strand, modified, valid of a pileup of combined modifications (code C).

    Contig names stay as they are. Anything that does not fit fails the whole: other columns
    or codes, sites of other than one base, counts that do not add up or have another
    modification, a percentage off its counts by more than PERCENT_TOLERANCE, a strand twice
    at a site, and a site without strand beside any other row of it.
    """
    r = text.where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.split(F.trim("value"), r"\s+").alias("c"))
    r = checked(r, (F.size("c") == 18) & (col(3) == "C"), "not a line of 18 columns and code C")
    names = {"pos": 1, "end": 2, "valid": 9, "modified": 11, "canonical": 12, "other": 13, "deleted": 14, "failed": 15, "differing": 16, "uncalled": 17}
    r = r.select(col(0).alias("chrom"), col(5).alias("strand"), col(10).try_cast("double").alias("percent"), *[col(i).try_cast("long").alias(n) for n, i in names.items()])
    r = checked(r, F.forall(F.array(*names), lambda n: n >= 0) & (F.col("end") == F.col("pos") + 1) & (F.col("chrom") != ""), "invalid position or counts")
    r = checked(r, (F.col("valid") == F.col("modified") + F.col("canonical")) & (F.col("other") == 0), "counts of combined modifications do not add up")
    close = (F.col("valid") == 0) | (F.abs(F.col("percent") - F.try_divide(100 * F.col("modified"), F.col("valid"))) <= PERCENT_TOLERANCE)
    r = checked(r, F.col("percent").between(0, 100) & close, "percentage and counts differ")
    r = checked(r, F.col("strand").isin("+", "-", "."), "invalid strand")
    site = Window.partitionBy("chrom", "pos")
    r = r.withColumn("rows", F.count(F.lit(1)).over(site)).withColumn("strands", F.size(F.collect_set("strand").over(site))).withColumn("bare", F.max(F.col("strand") == ".").over(site))
    r = checked(r, (F.col("rows") == F.col("strands")) & ((F.col("rows") == 1) | ~F.col("bare")), "a site's strands are repeated or overlap")
    return r.select("chrom", "pos", "strand", "modified", "valid")


def probe_positions(text: DataFrame) -> DataFrame:
    """chrom, pos, probe of a map of single bases; a repeated line or a probe on two contigs fails the whole."""
    r = text.where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t").alias("c"))
    r = r.select(col(0).alias("chrom"), col(1).try_cast("long").alias("pos"), col(2).try_cast("long").alias("end"), col(3).alias("probe"))
    fits = (F.col("chrom") != "") & (F.col("probe") != "") & (F.col("pos") >= 0) & (F.col("end") == F.col("pos") + 1)
    r = checked(r, fits, "probe map line is no single base with a name")
    r = checked(r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chrom", "pos", "probe"))), F.col("n") == 1, "probe mapping stands twice")
    r = r.withColumn("contigs", F.size(F.collect_set("chrom").over(Window.partitionBy("probe"))))
    return checked(r, F.col("contigs") == 1, "probe lies on two contigs").select("chrom", "pos", "probe")


def combined_probe_fractions(sites: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, modified, valid, fraction): counts of all sites and strands of a probe, pooled; those without a valid call left out.

    ``sites`` as ``combined_bedmethyl`` and ``probes`` as ``probe_positions`` give them. A
    site outside the map fails the whole.
    """
    met = checked(sites.join(probes, ["chrom", "pos"], "left"), F.col("probe").isNotNull(), "a site lies outside the probe map")
    sums = met.groupBy("probe").agg(F.sum("modified").alias("modified"), F.sum("valid").alias("valid")).where("valid > 0")
    return sums.withColumn("fraction", F.col("modified") / F.col("valid"))


def gtf(text: DataFrame) -> DataFrame:
    """feature, chrom, start_pos, end_pos, strand, phase, attributes, tags of each line."""
    pairs = F.regexp_extract_all(col(8), F.lit(r'(\w+) "([^"]*)"'), F.lit(1)), F.regexp_extract_all(col(8), F.lit(r'(\w+) "([^"]*)"'), F.lit(2))
    zipped = F.arrays_zip(pairs[0].alias("k"), pairs[1].alias("v"))
    tags = F.transform(F.filter(zipped, lambda p: p["k"] == "tag"), lambda p: p["v"])
    single = F.map_from_entries(F.transform(F.filter(zipped, lambda p, i: (p["k"] != "tag") & (F.array_position(pairs[0], p["k"]) == i + 1)), lambda p: F.struct(p["k"], p["v"])))
    r = _rows(text)
    return r.select(col(2).alias("feature"), normalize_contig(col(0)).alias("chrom"), (col(3).cast("long") - 1).alias("start_pos"), col(4).cast("long").alias("end_pos"), col(6).alias("strand"), col(7).try_cast("int").alias("phase"), single.alias("attributes"), tags.alias("tags"))


def gtf_transcripts(features: DataFrame) -> DataFrame:
    """Transcript rows with summed exon and CDS lengths and the flags of their tags."""
    key = F.col("attributes")["transcript_id"]
    size = F.col("end_pos") - F.col("start_pos")
    lengths = features.where("feature IN ('exon', 'CDS')").groupBy(key.alias("transcript_id")).agg(F.sum(F.when(F.col("feature") == "CDS", size).otherwise(0)).alias("cds_length"), F.sum(F.when(F.col("feature") == "exon", size).otherwise(0)).alias("transcript_length"))
    tag = lambda t: F.array_contains("tags", t)
    appris = F.get(F.filter("tags", lambda t: F.startswith(t, F.lit("appris_"))), F.lit(0))
    rows = features.where("feature = 'transcript'").select(key.alias("transcript_id"), F.col("attributes")["gene_id"].alias("gene_id"), F.col("attributes")["gene_name"].alias("gene_name"), F.col("attributes")["transcript_type"].alias("transcript_type"), "chrom", "start_pos", "end_pos", "strand", tag("Ensembl_canonical").alias("is_canonical"), tag("basic").alias("is_basic"), appris.alias("appris"))
    out = rows.join(lengths, "transcript_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cds_length", "transcript_length")})


def gff3_attributes(text: Column) -> Column:
    """``k=v;...`` of an annotation line as a map, percent-decoded."""
    items = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1), percent_decode(F.substring_index(x, "=", -1)))))


def cytobands(text: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, band, stain; unnamed and repeated bands are left out."""
    r = _rows(text).select(normalize_contig(col(0)).alias("chrom"), col(1).cast("long").alias("start_pos"), col(2).cast("long").alias("end_pos"), col(3).alias("band"), col(4).alias("stain"))
    return r.where("band <> ''").dropDuplicates()


def contig_table(text: DataFrame) -> DataFrame:
    """chrom and length of a sequence index."""
    return _rows(text).select(col(0).alias("chrom"), col(1).cast("long").alias("length"))


def sam_header(text: DataFrame) -> DataFrame:
    """(record, fields) of header lines; fields is a map of two-letter tags."""
    r = text.where("startswith(value, '@')").select(F.split("value", "\t").alias("c"))
    items = F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2), F.substr(x, F.lit(4))))
    return r.select(F.substring(col(0), 2, 2).alias("record"), F.map_from_entries(items).alias("fields"))


def read_calls(rows: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Read-level calls by likelihood ratio with state M, U or A; needs its named columns."""
    from genostrata.operators.mixture import call_state

    need = ["chromosome", "strand", "start", "end", "read_name", "log_lik_ratio", "num_motifs", "sequence"]
    if missing := [c for c in need if c not in rows.columns]:
        raise ValueError(f"missing columns {missing}")
    llr, n = F.col("log_lik_ratio").cast("double"), F.col("num_motifs").cast("int")
    marker = F.concat_ws(":", "chromosome", F.concat_ws("-", "start", "end"), "strand", F.col("num_motifs").cast("string"), F.sha2("sequence", 256))
    return rows.select("read_name", marker.alias("marker_id"), call_state(llr, n, threshold).alias("state"))


QC = "alignment_stats map<string,double>, read_stats map<string,double>, histograms struct<read_length:struct<bins:array<struct<start:long,end:long,count:long,bases:long>>>>"


def qc_metrics(text: DataFrame) -> DataFrame:
    """(metric, value) of a quality document given as one JSON line."""
    doc = text.select(F.from_json("value", QC).alias("d"))
    both = F.map_concat(F.coalesce("d.alignment_stats", F.create_map().cast("map<string,double>")), F.coalesce("d.read_stats", F.create_map().cast("map<string,double>")))
    return doc.select(F.explode(both).alias("metric", "value"))


def qc_histogram(text: DataFrame) -> DataFrame:
    """start, end, count, bases of the read-length histogram; the last end may be null."""
    return text.select(F.from_json("value", QC).alias("d")).select(F.inline("d.histograms.read_length.bins"))


def target_depths(text: DataFrame, targets: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, region_id, mean_depth of a per-target depth file of 4 or 5 columns.

    The regions must be exactly ``targets``: one too many, one too few or one twice fails the
    whole, as a depth that is no number does.
    """
    r = _rows(text)
    depth = F.when(F.size("c") == 5, col(4)).when(F.size("c") == 4, col(3)).try_cast("double")
    r = r.select(normalize_contig(col(0)).alias("chrom"), col(1).try_cast("long").alias("start_pos"), col(2).try_cast("long").alias("end_pos"), F.when(F.size("c") == 5, col(3)).alias("region_id"), depth.alias("mean_depth"))
    r = checked(r, F.col("mean_depth") >= 0, "malformed depth line")
    key = ["chrom", "start_pos", "end_pos"]
    counted = r.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("region_id").alias("region_id"), F.first("mean_depth").alias("mean_depth"))
    both = counted.join(targets.select(*key, F.lit(True).alias("wanted")).distinct(), key, "full")
    return checked(both, (F.col("n") == 1) & F.col("wanted"), "regions are not the target set").select(*key, "region_id", "mean_depth")


def region_list(text: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos of lines ``chr:first-last`` (1-based, both ends in), converted to half-open."""
    parts = lambda i: F.regexp_extract(F.trim("value"), r"^([^:\s]+):(\d+)-(\d+)$", i)
    r = text.where("trim(value) <> '' AND NOT startswith(value, '#')").select(normalize_contig(parts(1)).alias("chrom"), (parts(2).try_cast("long") - 1).alias("start_pos"), parts(3).try_cast("long").alias("end_pos"))
    return checked(r, (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")), "malformed region line")


def target_gene_map(text: DataFrame) -> DataFrame:
    """target, gene, chrom, resolution of a map with exactly that header; targets and (gene, chrom) stand once."""
    names = ["target", "gene", "chrom", "resolution"]
    head = F.concat_ws("\t", *map(F.lit, names))
    r = checked(text.where("trim(value) <> ''"), ~F.startswith("value", F.lit("target")) | (F.col("value") == head), "unexpected header")
    r = r.where(F.col("value") != head).select(F.split("value", "\t").alias("c")).select(*[col(i).alias(n) for i, n in enumerate(names)])
    r = checked(r, F.col("resolution").isin("curated", "label", "unresolved"), "unknown resolution")
    for keys in (["target"], ["gene", "chrom"]):
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        r = checked(r.withColumn("n", n), (F.col("n") == 1) | F.col(keys[0]).isNull(), f"repeated {keys[0]}").drop("n")
    return r


def probe_map(text: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, probe, fraction of a probe file of four or five columns; NA fractions are null.

    A probe on two contigs fails the whole.
    """
    r = _rows(text).select(normalize_contig(col(0)).alias("chrom"), col(1).try_cast("long").alias("start_pos"), col(2).try_cast("long").alias("end_pos"), col(3).alias("probe"), F.when(col(4) != "NA", col(4).try_cast("double")).alias("fraction"), (F.size("c") == 5) & (col(4) != "NA"))
    r = r.toDF("chrom", "start_pos", "end_pos", "probe", "fraction", "given")
    r = checked(r, (F.col("end_pos") > F.col("start_pos")) & (~F.coalesce("given", F.lit(False)) | F.col("fraction").between(0, 1)), "malformed probe line")
    contigs = r.groupBy("probe").agg(F.count_distinct("chrom").alias("n"))
    return checked(r.join(contigs, "probe"), F.col("n") == 1, "probe on several contigs").select("chrom", "start_pos", "end_pos", "probe", "fraction")


def probability_bin(p: Column) -> Column:
    """struct(low, high) of the 256th in which a probability stands as its midpoint; null if it is no midpoint."""
    byte = F.bround(p * 256 - 0.5).cast("int")
    fine = byte.between(0, 255) & (F.abs(p - (byte + 0.5) / 256) <= 1e-7)
    return F.when(fine, F.struct((byte / 256).alias("low"), ((byte + 1) / 256).alias("high")))


def interval_state(intervals: Column, codes: list[str], threshold: float) -> Column:
    """M, U or A from a map of code to struct(low, high): D17.

    Methylated if the lower bound of m reaches the threshold, unmethylated if one less all
    upper bounds does, ambiguous otherwise or where a code is missing; lower bounds that
    exceed one in sum fail.
    """
    known = F.forall(F.array(*map(F.lit, codes)), lambda k: F.element_at(intervals, k).isNotNull()) & (F.size(intervals) == len(codes))
    lows = F.aggregate(F.map_values(intervals), F.lit(0.0), lambda s, x: s + F.coalesce(x["low"], F.lit(0.0)))
    highs = F.aggregate(F.map_values(intervals), F.lit(0.0), lambda s, x: s + F.coalesce(x["high"], F.lit(0.0)))
    state = F.when(F.element_at(intervals, F.lit("m"))["low"] >= threshold, "M").when(F.greatest(F.lit(0.0), 1 - highs) >= threshold, "U").otherwise("A")
    return F.when(~known, "A").when(lows > 1 + 1e-7, F.raise_error(F.lit("probabilities exceed one")).cast("string")).otherwise(state)


def explicit_calls(rows: DataFrame, *, codes: tuple[str, ...] = ("m", "h"), threshold: float = 0.8, excluded_flags: int = 0x904) -> DataFrame:
    """(read_name, chrom, pos, strand, state) of a read-level probability table, one row a read and site.

    ``rows(read_id, chrom, ref_position, ref_strand, mod_code, mod_qual, flag)``: rows of reads
    with one of ``excluded_flags`` are left out, as are unaligned ones; a code twice for one
    site of a read, or a quality that is no midpoint, fails.
    """
    r = rows.where((F.col("flag").bitwiseAND(F.lit(excluded_flags)) == 0) & (F.col("ref_position") >= 0) & F.col("mod_code").isin(*codes))
    r = checked(r.withColumn("interval", probability_bin(F.col("mod_qual"))), F.col("interval").isNotNull(), "quality is no midpoint")
    per = r.groupBy(F.col("read_id").alias("read_name"), "chrom", F.col("ref_position").alias("pos"), F.col("ref_strand").alias("strand")).agg(F.collect_list(F.struct("mod_code", "interval")).alias("x"), F.count_distinct("mod_code").alias("n"))
    per = checked(per, F.size("x") == F.col("n"), "a code stands twice for a site of a read")
    return per.select("read_name", "chrom", "pos", "strand", interval_state(F.map_from_entries("x"), list(codes), threshold).alias("state"))


def segment_table(text: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, copy_number, call, use of a segment or bin table with a header.

    Every line must say ``zero_based_half_open`` as its coordinate system and have a span.
    """
    r = _rows(text).where(col(0) != "chrom")
    number = lambda i: F.nullif(col(i), F.lit("NA")).try_cast("double")
    r = r.select(normalize_contig(col(0)).alias("chrom"), col(1).try_cast("long").alias("start_pos"), col(2).try_cast("long").alias("end_pos"), number(3).alias("copy_number"), number(4).alias("call"), F.upper(col(5)).isin("TRUE", "1").alias("use"), col(6).alias("system"))
    return checked(r, (F.col("system") == "zero_based_half_open") & (F.col("end_pos") > F.col("start_pos")), "malformed segment line").drop("system")


def parameters(text: DataFrame) -> DataFrame:
    """(name, value) of lines ``name:<TAB>value``, NA as null."""
    r = text.where(F.col("value").rlike(r"^[^\t:]+:\s")).select(F.substring_index("value", ":", 1).alias("name"), F.trim(F.regexp_replace("value", r"^[^\t:]+:\s+", "")).alias("value"))
    return r.select("name", F.when(F.col("value").isin("NA", ""), None).otherwise(F.col("value")).alias("value"))


def selected_fit(fits: DataFrame) -> DataFrame:
    """The fit of rank 1 of ``fits(rank, purity, ploidy, ...)``; none or several of that rank fail."""
    n = checked(fits.agg(F.count_if(F.col("rank") == 1).alias("n")), F.col("n") == 1, "not exactly one selected fit")
    return n.join(fits.where("rank = 1"), F.lit(True), "left").drop("n")


def class_annotation(rows: DataFrame, n_units: int = 42) -> DataFrame:
    """``rows(unit, class, family, lineage)`` if units 1 to ``n_units`` stand exactly once each, else an error."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("d"), F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    whole = (F.col("n") == n_units) & (F.col("d") == n_units) & (F.col("lo") == 1) & (F.col("hi") == n_units)
    return checked(sums, whole, "units are not 1 to n once each").select("n").join(rows, F.lit(True), "left").drop("n")


def knowledge(text: DataFrame, *, reportable: bool = True) -> DataFrame:
    """record_id, pattern_type, genes, status of knowledge records, one JSON object a line.

    For ``reportable`` use a draft fails the whole; without it drafts come along.
    """
    d = text.select(F.from_json("value", "record_id string, pattern_type string, genes array<string>, status string").alias("d")).select("d.*")
    d = checked(d, F.col("record_id").isNotNull() & F.col("status").isin("released", "draft"), "malformed record")
    return checked(d, F.col("status") == "released", "draft in reportable knowledge") if reportable else d


def histogram_table(text: DataFrame) -> DataFrame:
    """start, end (null in the last), count, bases of a histogram side file with exactly that header."""
    r = checked(text, ~F.startswith("value", F.lit("start")) | (F.col("value") == "start\tend\tcount\tbases"), "unexpected header")
    r = _rows(r).where(col(0) != "start")
    r = r.select(col(0).try_cast("long").alias("start"), F.nullif(col(1), F.lit("")).try_cast("long").alias("end"), col(2).try_cast("long").alias("count"), col(3).try_cast("long").alias("bases"))
    return checked(r, F.col("start").isNotNull() & F.col("count").isNotNull() & F.col("bases").isNotNull(), "malformed histogram line")
