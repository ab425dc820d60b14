"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Words are ordered by rarity over the whole corpus (exact
counts of hash buckets, a fixed-size table), so two lines of similarity p share a word
among the first n - ceil(p n) + 1 of each. Lines of equal sets are one class. Classes are
posted under their prefix words; length, position and parity-bitmap filters, none of which
loses a match, pick the classes that have a near neighbour; those few are joined and
verified on their words. A line is removed if an earlier line, in (doc_id, line number)
order, has the same set or one of Jaccard similarity at least p, however few words it has.
Scripts written without blanks are cut into pairs of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import Scratch, fresh, read

PERCENT = 80
#: Hash buckets of the rarity table; its size is the same for every corpus.
BUCKETS = 1 << 20
#: Earliest classes of each posting list that are tried first, one for each hash class.
HUBS = 4

#: 64-bit parity bitmaps of the lines that have a near neighbour (a power of two).
WIDE = 4
#: Up to so many narrow rows may be broadcast: some 30 bytes each, 15 MB in all.
MOST_BROADCAST = 500_000

_SPACE = r"[ \t\r\f\x0B]+"
#: Characters of scripts without blanks: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = r"[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}]"


#: What keeps a line from being cut at single spaces: other white space, and scripts without
#: blanks (a wider range of characters is sent the long way, which cuts them alike).
_OTHER_SPACE = ("\t", "\r", "\f", "\x0b")
_HIGH = (r"[\u0E00-\uFFFF]", r"[\x{10000}-\x{10FFFF}]")


def _plain(text: Column) -> Column:
    """True if words of ``text`` are just what single spaces (and line feeds) separate."""
    odd = F.lit(False)
    for c in _OTHER_SPACE:
        odd |= F.contains(text, F.lit(c))
    high = F.lit(False)
    for c in _HIGH:
        high |= text.rlike(c)
    return ~(odd | ((F.octet_length(text) > F.length(text)) & high))


def _words(line: Column, plain: Column) -> Column:
    """What blanks separate; in scripts without blanks each character with the next one."""
    pairs = F.regexp_replace(line, f"({_UNSPACED})(?=({_UNSPACED}))|({_UNSPACED})", " $1$2$3 ")
    cut = F.when(F.octet_length(line) > F.length(line), pairs).otherwise(line)
    words = F.when(plain, F.split(F.lower(line), " ")).otherwise(F.split(F.lower(cut), _SPACE))
    return F.array_remove(words, "")


def _lines(docs: DataFrame, *others: Column | str) -> DataFrame:
    """``others`` with plain, line_no and line for each line of column text.

    Lines are listed before they become rows, so what concerns the whole text is found once
    for each text and not once for each line.
    """
    listed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    rows = docs.select(*others, _plain(F.col("text")).alias("plain"), listed.alias("lines"))
    return rows.select(*[c for c in rows.columns if c != "lines"], F.inline_outer("lines"))


def rarity_table(texts: DataFrame, text: str) -> Column:
    """An array: frequency class (log scale) of each hash bucket, in the high bits, as a scalar subquery.

    The order it gives only has to be one order for all lines, so the words counted are
    simply what blanks separate.
    """
    words = texts.select(F.explode(F.split(text, " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    level = F.coalesce(F.least(F.lit(127), F.floor(F.log2("c") * 3)).cast("long"), F.lit(0))
    every = texts.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    pairs = F.sort_array(F.collect_list(F.struct("bucket", F.shiftleft(level, 40).alias("level"))))
    return every.agg(F.transform(pairs, lambda p: p["level"]).alias("levels")).scalar()


def line_classes(docs: DataFrame, percent: int) -> DataFrame:
    """(d, th, line_no, cls, n, bits, prefix) of every line.

    docs(d long, text); th tells apart texts of one d. cls is a hash of the word set, bits a
    bitmap of its words, prefix its rarest words in order of rarity.
    """
    lines = _lines(docs, "d", F.xxhash64("text").alias("th"))
    # The table joins the projection after lines have become rows: no row carries a copy of it.
    lines = lines.select("*", rarity_table(docs, "text").alias("levels"))
    level = lambda w: F.get("levels", F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    words = _words(F.col("line"), F.col("plain"))
    ordered = F.transform(words, lambda w: level(w).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 24)))
    sets = lines.select("d", "th", "line_no", F.sort_array(F.array_distinct(ordered)).alias("s"))
    n = F.size("s")
    prefix = F.slice("s", F.lit(1), n - F.expr(f"cast(({percent}L * size(s) + 99) div 100 as int)") + 1)
    return sets.select("d", "th", "line_no", F.xxhash64("s").alias("cls"), n.alias("n"), parity("s").alias("bits"), prefix.alias("prefix"))


def small_enough(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """``df`` (a written table of narrow rows) with a broadcast hint if it has at most ``rows`` rows.

    With more, the join it takes part in is left to the planner, which shuffles both sides.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parity(words: str) -> Column:
    """A 64-bit parity bitmap of the array's hashes."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(bit(w)))


def wide_parities(tokens: DataFrame, names: list[str]) -> DataFrame:
    """(cls, one column for each of ``names``): parity bitmaps of the hashes dealt among them."""
    rows = tokens.select("cls", F.explode("words").alias("w"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w").bitwiseAND(F.lit(63)).cast("int"))
    part = F.shiftright("w", 6).bitwiseAND(F.lit(len(names) - 1))
    return rows.groupBy("cls").agg(*[F.bit_xor(F.when(part == i, bit).otherwise(F.lit(0).cast("long"))).alias(name) for i, name in enumerate(names)])


def _differ(x: str, y: str, bitmaps: list[str]) -> Column:
    """Words that two sets certainly do not share: differing parity bits."""
    counts = [F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in bitmaps]
    return sum(counts[1:], counts[0])


def _may_match(x: str, y: str, percent: int, bitmaps: list[str]) -> Column:
    """Length and bitmap filters; both hold for every pair of similarity percent / 100."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    length = F.lit(100) * F.least(nx, ny) >= F.lit(percent) * F.greatest(nx, ny)
    return length & (_differ(x, y, bitmaps) * (100 + percent) <= (nx + ny) * (100 - percent))


def near_posts(lines: DataFrame, percent: int) -> DataFrame:
    """(key, pos, cls, n, bits): prefix postings that meet another class through all filters."""
    posts = lines.select("cls", "n", "bits", "prefix").distinct().select("cls", "n", "bits", F.posexplode("prefix").alias("pos", "key"))
    x, y = posts.alias("x"), posts.alias("y")
    # If the shared word is the first one of both, no more than these words can be shared.
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    position = rest * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    other = (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") != F.col("y.cls"))
    return x.join(y, other & _may_match("x", "y", percent, ["bits"]) & position, "left_semi")


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (y, x) whose word sets have Jaccard similarity percent / 100 or more."""
    a, b = tokens.toDF("y", "wy"), tokens.toDF("x", "wx")
    both = F.size(F.array_intersect("wx", "wy"))
    return pairs.join(a, "y").join(b, "x").where(both * 100 >= (F.size("wx") + F.size("wy") - both) * percent).select("y", "x")


def may_have_near(percent: int) -> Column:
    """True if a set of n words can be similar to a different one, which then has n + 1 words or fewer."""
    return F.col("n") * (100 - percent) >= percent


def removed_lines(docs: DataFrame, scratch: Scratch, *, percent: int = PERCENT) -> DataFrame:
    """(d, th, removed): the line numbers to remove from each text that loses any.

    docs(d long, text), without null texts. The result reads tables of ``scratch``.
    """
    lines = scratch.table(line_classes(docs, percent)).where("n > 0")
    firsts = scratch.table(lines.groupBy("cls").agg(F.min(F.struct("d", "th", "line_no")).alias("first"), F.count(F.lit(1)).alias("times")))
    near = scratch.table(near_posts(lines.where(may_have_near(percent)), percent))
    known = scratch.table(firsts.join(near.select("cls").distinct(), "cls"))

    # The words of the lines where a near class comes first, as 64-bit hashes, cut from the texts again.
    where = small_enough(known.select("cls", F.col("first.d").alias("d2"), F.col("first.th").alias("th2"), F.col("first.line_no").alias("line2")))
    ids = scratch.table(where.select(F.col("d2").alias("d"), F.col("th2").alias("th")).distinct())
    texts = docs.withColumn("th", F.xxhash64("text")).alias("t").join(small_enough(ids).alias("i"), F.expr("t.th = i.th AND t.d <=> i.d"), "left_semi")
    texts = _lines(texts, "d", "th")
    on = (F.col("th") == F.col("th2")) & (F.col("line_no") == F.col("line2")) & F.col("d").eqNullSafe(F.col("d2"))
    found = texts.join(where, on).select("cls", "line", "plain").dropDuplicates(["cls"])
    tokens = scratch.table(found.select("cls", F.array_distinct(F.transform(_words(F.col("line"), F.col("plain")), lambda w: F.xxhash64(w))).alias("words")))

    # The few lines left have wider bitmaps, which tell near misses from matches.
    wide = [f"b{i}" for i in range(WIDE)]
    near = scratch.table(near.select("key", "cls", "n").join(known.select("cls", "first").join(wide_parities(tokens, wide), "cls"), "cls"))

    def earlier(ys: DataFrame, xs: DataFrame) -> DataFrame:
        on = (F.col("y.key") == F.col("x.key")) & (F.col("x.first") < F.col("y.first"))
        pairs = ys.alias("y").join(xs.alias("x"), on & _may_match("x", "y", percent, wide))
        return pairs.select(F.col("y.cls").alias("y"), F.col("x.cls").alias("x"), _differ("x", "y", wide).alias("differ"))

    # First the likeliest of the early classes, for each class one; then, for what is left, all.
    hubs = near.groupBy("key", F.pmod("cls", F.lit(HUBS)).alias("part")).agg(F.min(F.struct("first", "cls", "n", *wide)).alias("h")).select("key", "h.*")
    tried = scratch.table(earlier(near, hubs).groupBy("y").agg(F.min(F.struct("differ", "x")).alias("m")).select("y", F.col("m.x").alias("x")))
    similar = scratch.table(verified(tried, tokens, percent).select(F.col("y").alias("cls")))
    rest = earlier(near.join(similar, "cls", "left_anti"), near).select("y", "x").distinct().join(tried, ["y", "x"], "left_anti")
    more = verified(rest, tokens, percent).select(F.col("y").alias("cls")).distinct()
    similar = scratch.table(similar.union(more).withColumn("similar", F.lit(True)))

    verdict = firsts.join(similar, "cls", "left").where("similar OR times > 1").select("cls", "first", F.coalesce("similar", F.lit(False)).alias("similar"))
    verdict = small_enough(scratch.table(verdict))
    gone = lines.select("d", "th", "line_no", "cls").join(verdict, "cls").where(F.col("similar") | (F.struct("d", "th", "line_no") != F.col("first")))
    return gone.groupBy("d", "th").agg(F.collect_set("line_no").alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, percent: int = PERCENT) -> DataFrame:
    """``docs`` with later matching lines taken out of ``text``, plus n_lines and n_removed.

    ``doc_id`` must be an integer column; a null comes before all ids. Words are lower-cased
    and split on white space other than the line feed, and scripts without blanks into pairs of
    characters. Lines of any number of words are compared; lines without a word stay. A null
    text stays null and an empty text empty, with n_lines 0
    and 1. Rows that repeat an id and a text are one document and lose the same lines; texts
    that share an id come in the order of a hash. Columns n_lines and n_removed of ``docs``
    are replaced, other columns pass through.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text")).where("text IS NOT NULL")
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.table(removed_lines(base, scratch, percent=percent), keep=True)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, lines, n, d, th, removed = fresh(names, "key", "lines", "n", "d", "th", "removed")
    gone = gone.toDF(d, th, removed)
    numbers = gone.agg(F.sum(F.size(removed) + 4)).first()[0] or 0  # a row is some four numbers and the list
    gone = F.broadcast(gone) if numbers <= 4 * MOST_BROADCAST else gone
    rows = docs.select(*names, F.xxhash64(text).alias(key))
    on = F.col(doc_id).cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(th))
    rows = rows.join(gone, on, "left").withColumn(lines, F.split(text, "\n"))
    rows = rows.withColumn(n, F.when(F.col(text).isNotNull(), F.size(lines)).otherwise(0))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), removed))
    short = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    new = F.when(F.col(removed).isNull(), F.col(text)).otherwise(short)
    kept = [new.alias(c) if c == text else F.col(c) for c in names]
    return rows.select(*kept, F.col(n).cast("long").alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, text without later matches, n_lines, n_removed of every document."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later matching lines; a document that loses every word goes."""
    # Columns by the names of the result are set aside and come back after it.
    kept = [F.col(c).alias(f"kept_{i}") if c.lower() in ("n_lines", "n_removed") else F.col(c) for i, c in enumerate(docs.columns)]
    rows = dedup_lines(docs.select(*kept)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\r\n\f\x0B]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*[F.col(f"kept_{i}").alias(c) if c.lower() in ("n_lines", "n_removed") else F.col(c) for i, c in enumerate(docs.columns)])
