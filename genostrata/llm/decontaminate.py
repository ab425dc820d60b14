"""Benchmark decontamination by template windows.

Words become template tokens: numbers, names and units turn into typed placeholders, all
other words into lower-cased literals. Windows of template tokens are hash-joined with
those of the benchmark items. On each alignment (document position less item position) the
words that fill the placeholders are held against each other: where they map one to one from
item to document, a question with other numbers or names is caught by a share of its
windows; where they do not, half of the windows must agree, so chance agreement of templates
is not caught. Items that
are dense with placeholders have longer windows, and items of too few literals are looked
for word by word, as a whole and with their own values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import Scratch, mix64, read, window_hashes

#: Template tokens in a window; items shorter than this are searched by one window of all
#: their tokens. A window needs so many literals; an item without such a window has windows
#: of 2, 4, 8 ... times the tokens or of all its tokens, whichever first has enough.
WINDOW = 8
LEAST_LITERALS = 5
#: Least share of an item's windows found in a document.
MIN_COVERAGE = 0.25
#: The same for an alignment whose slots do not map one to one.
CLASH_COVERAGE = 0.5
#: Up to so many benchmark windows (8 bytes each) are broadcast as a filter; with more,
#: every window of every document takes part in a shuffled hash join instead.
MOST_BROADCAST = 2_000_000

UNITS = frozenset("mm cm m km mg g kg lb lbs oz t ml l s sec secs second seconds ms min mins minute minutes h hr hrs hour hours day days week weeks month months year years mile miles foot feet ft inch inches yard yards meter meters metre metres gram grams kilogram kilograms liter liters litre litres dollar dollars cent cents euro euros pound pounds percent degree degrees mph kmh kb mb gb tb hz khz mhz ghz v w kw a j kj cal kcal".split())

_NUMBER = re.compile(r"[+\-(]*[$€£¥]?\d[\d.,:/]*(?:%|\w{0,3})\W*")
_NAME = re.compile(r"\W*[^\W\d_a-z][^\W\d_A-Z]+(?:['’-][^\W\d_]+)*\W*")
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
#: Characters of scripts without blanks, each a token: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]")
_BREAK, _GAP = "\x01", "\x02"

#: Low bits of a token's hash: number, unit, name-like, ends a sentence, not a word, gap between texts.
N, U, C, E, D, G = (np.uint64(1 << i) for i in range(6))
_FLAGS = np.uint64(63)
_PLACEHOLDER = {int(k): np.uint64(xxhash.xxh3_64_intdigest(v) & ~63) for k, v in ((N, b"<num>"), (U, b"<unit>"), (C, b"<name>"))}
_CHUNK = 2_000_000


class Tokens(dict):
    """Word to hash and flags; forgets everything when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        if word == _BREAK:
            flags, core = int(E | D), ""
        elif word == _GAP:
            flags, core = int(G | E), word
        else:
            core = _STRIP.sub("", word.casefold())
            flags = 0 if core else int(D)
            if _NUMBER.fullmatch(word):
                flags |= int(N)
            elif core in UNITS:
                flags |= int(U)
            elif _NAME.fullmatch(word):
                flags |= int(C)
            if word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"):
                flags |= int(E)
        self[word] = out = (xxhash.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass")) & ~63) | flags
        return out


class Literals(dict):
    """Word to hash of the word itself, less case and the marks around a phrase; bounded as Tokens."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        folded = word.casefold()
        core = folded.lstrip("\"'([{“‘«").rstrip(".,;:!?\"')]}”’»。，！？；：") or folded
        self[word] = out = xxhash.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass"))
        return out


def _cut(text: str) -> str:
    return text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)


def literals(texts: list[str | None], cache: Literals):
    """The same as ``templates`` gives, for words as they are: no placeholder, no name runs."""
    words: list[str] = []
    ends = []
    for t in texts:
        if t:
            words += _cut(t).split()
        words.append(_GAP)
        ends.append(len(words))
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    gap = np.zeros(len(words), bool)
    gap[np.asarray(ends, int) - 1] = True
    h[gap] = mix64(np.arange(len(ends), dtype=np.uint64) + np.uint64(1))
    start = np.arange(len(words))
    return words, h, np.zeros(len(words), bool), gap, start, np.searchsorted(np.asarray(ends), start, side="right")


def templates(texts: list[str | None], cache: Tokens):
    """words, h, slot, start, of: the template tokens of all texts with a gap after each.

    h is the token's hash (of its placeholder if slot), start its place in words, of the
    text it belongs to. A run of names is one token.
    """
    words: list[str] = []
    ends = []
    for t in texts:
        if t:
            words += _cut(t).replace("\n", f" {_BREAK} ").split()
        words.append(_GAP)
        ends.append(len(words))
    raw = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    start = np.flatnonzero((raw & D) == 0)
    # A mark without letters may end a sentence too: carry its flag to the next word.
    ended = np.concatenate([[0], np.cumsum((raw & E) != 0)])
    before = np.concatenate([[0], start[:-1]]) if len(start) else start
    after_end = ended[start] > ended[before]
    raw = raw[start]
    if len(raw):
        after_end[0] = True
    prev = np.concatenate([[np.uint64(0)], raw[:-1]]) if len(raw) else raw
    number = (raw & N) != 0
    unit = ((raw & U) != 0) & ((prev & N) != 0)
    name = ((raw & C) != 0) & ~after_end & ~number
    h = raw & ~_FLAGS
    for at, kind in ((number, N), (unit, U), (name, C)):
        h[at] = _PLACEHOLDER[int(kind)]
    gap = (raw & G) != 0
    h[gap] = mix64(np.arange(gap.sum(), dtype=np.uint64) + np.uint64(1))
    keep = ~(name & np.concatenate([[False], name[:-1]])) if len(raw) else name
    start = start[keep]
    return words, h[keep], (number | unit | name)[keep], gap[keep], start, np.searchsorted(np.asarray(ends), start, side="right")


def _values(words: list[str], start: np.ndarray, at: int) -> str:
    stop = start[at + 1] if at + 1 < len(start) else start[at] + 1
    return " ".join(_STRIP.sub("", w.casefold()) for w in words[start[at] : stop] if w not in (_BREAK, _GAP)).strip()


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, item_key, literal, width, hash, item_pos, item_slots, need, total: the windows to look for.

    literal tells windows of words as they are, which an item of fewer than LEAST_LITERALS
    literals has; need is the number of windows that must be found on one alignment, total
    that of the item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, plain = Tokens(), Literals()
        for batch in batches:
            which, out = [], [[] for _ in range(7)]
            for row, text in enumerate(batch.column("text").to_pylist()):
                words, h, slot, _, start, _ = templates([text], tokens)
                n, literal = len(h) - 1, False
                before = np.concatenate([[0], np.cumsum(slot)])
                widths = [min(n, WINDOW), *(WINDOW << i for i in range(1, 32) if WINDOW << i < n), n]
                for width in widths:
                    places = np.flatnonzero(before[width:-1] - before[: n - width + 1] <= width - LEAST_LITERALS)
                    if len(places):
                        break
                else:
                    literal = True
                    words, h, slot, _, start, _ = literals([text], plain)
                    width = min(len(h) - 1, WINDOW)
                    places = np.arange(len(h) - width) if width else np.empty(0, int)
                hashes = window_hashes(h[:-1], width).view(np.int64) if width else h
                for p in map(int, places):
                    which.append(row)
                    values = [_values(words, start, i) for i in range(p, p + width) if slot[i]]
                    for c, v in zip(out, (literal, width, int(hashes[p]), p, values, len(places) if literal else 1, len(places)), strict=True):
                        c.append(v)
            types = (pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32())
            kept = batch.select(["item_id", "item_key"]).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, out, types)], names=["item_id", "item_key", "literal", "width", "hash", "item_pos", "item_slots", "need", "total"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"item_id {kind}, item_key bigint, literal boolean, width int, hash bigint, item_pos int, item_slots array<string>, need int, total int")


def template_windows(rows: DataFrame, text: str, widths: list[int], wanted: np.ndarray | None = None, literal: bool = False) -> DataFrame:
    """``rows`` without ``text``, once for each window: width, hash, pos, size, slots.

    pos counts template tokens from the text's start, size is the number of them in the
    text, slots are the words behind the window's placeholders. ``wanted`` (sorted hashes)
    leaves other windows out. Windows of fewer than LEAST_LITERALS literals are left out.
    With ``literal``, windows are of words as they are, and none is left out for that.
    """
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    added = "width int, hash bigint, pos int, size int, slots array<string>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, want = Literals() if literal else Tokens(), shared.value
        cut = literals if literal else templates
        least = 0 if literal else LEAST_LITERALS
        table = None
        if want is not None:
            table = np.zeros(1 << 20, bool)
            table[want >> np.uint64(44)] = True
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            kept = batch.select([c for i, c in enumerate(batch.schema.names) if i != at])
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < _CHUNK):
                    size += len(texts[hi] or "")
                    hi += 1
                words, h, slot, gap, start, of = cut(texts[lo:hi], cache)
                first = np.searchsorted(of, np.arange(hi - lo))
                sizes = np.bincount(of, minlength=hi - lo) - 1  # less the gap
                slots_before = np.concatenate([[0], np.cumsum(slot)])
                gaps_before = np.concatenate([[0], np.cumsum(gap)])
                out = [[] for _ in range(6)]
                for width in widths:
                    w = window_hashes(h, width)
                    n = len(w)
                    ok = (gaps_before[width:] == gaps_before[:n]) & (slots_before[width:] - slots_before[:n] <= width - least) if n else np.empty(0, bool)
                    if table is not None and n:
                        ok &= table[w >> np.uint64(44)]
                    found = np.flatnonzero(ok)
                    if want is not None and len(found):
                        place = np.minimum(np.searchsorted(want, w[found]), len(want) - 1)
                        found = found[want[place] == w[found]]
                    if len(found):
                        out[0].append(of[found] + lo)
                        out[1].append(np.full(len(found), width, np.int32))
                        out[2].append(w[found].view(np.int64))
                        out[3].append((found - first[of[found]]).astype(np.int32))
                        out[4].append(sizes[of[found]].astype(np.int32))
                        out[5] += [[_values(words, start, i) for i in range(p, p + width) if slot[i]] if slots_before[p + width] > slots_before[p] else [] for p in found]
                if out[0]:
                    which, *numbers = (np.concatenate(c) for c in out[:5])
                    columns = kept.take(pa.array(which)).columns + [pa.array(c) for c in numbers] + [pa.array(out[5], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept.schema.names, "width", "hash", "pos", "size", "slots"])
                lo = hi

    return rows.mapInArrow(run, f"{schema}, {added}")


def _one_to_one(pairs) -> F.Column:
    n = F.size(pairs)
    return (F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == n) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"]))) == n)


def _function(pairs) -> F.Column:
    """True if every value of the item is filled with one value of the document."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs)


def _half_kept(pairs) -> F.Column:
    """True if some value stays as it is in one place and goes, or comes, in another."""
    stay = F.transform(F.filter(pairs, lambda p: p["b"] == p["d"]), lambda p: p["b"])
    return F.exists(pairs, lambda p: (p["b"] != p["d"]) & (F.array_contains(stay, p["b"]) | F.array_contains(stay, p["d"])))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, min_coverage: float = MIN_COVERAGE, merged_values: bool = False) -> DataFrame:
    """One row for each document and benchmark item found in it.

    doc_id, text_hash (tells apart rows of one doc_id), item_id, n_windows (of the item
    found), item_windows, coverage, reparameterised (some placeholder is filled otherwise
    than in the item). A pair is reported if windows on alignments with one-to-one slots
    cover at least ``min_coverage`` of the item. On an alignment whose slots are not one to
    one (two equal numbers of the item became different ones, or two different ones equal)
    at least CLASH_COVERAGE of the item's windows must be found, or, if a value stays in one
    place and is changed in another, must be found with the item's own values. With
    ``merged_values`` the latter is not asked for where each value of the item is filled
    with one value of the document: new values that happen to be equal, or equal to another
    value of the item, then hide no copy. Items of fewer than LEAST_LITERALS literals are reported where all their words stand in order with their own values, even if it is
    one word. Null or empty texts match nothing. Repeated rows give one row. Texts are read
    whole; extra columns are not read.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    with Scratch(docs.sparkSession) as scratch:
        windows = scratch.table(item_windows(items.withColumn("item_key", F.xxhash64("text"))), keep=True)
    wanted = []
    for literal in (False, True):
        mine = windows.where(F.col("literal") == literal)
        if widths := sorted(r[0] for r in mine.select("width").distinct().collect()):
            hashes = mine.select("hash").distinct().limit(MOST_BROADCAST + 1).toArrow()["hash"].to_numpy()
            wanted.append((literal, widths, np.sort(hashes.view(np.uint64)) if len(hashes) <= MOST_BROADCAST else None))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    if not wanted:
        rows, wanted = rows.limit(0), [(False, [WINDOW], None)]
    parts = [template_windows(rows, "text", widths, hashes, literal).withColumn("literal", F.lit(literal)) for literal, widths, hashes in wanted]
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    met = found.join(windows, ["literal", "width", "hash"])
    pair = F.transform(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")), lambda p: F.struct(p["b"].alias("b"), p["d"].alias("d")))
    same = F.when(F.col("item_slots") == F.col("slots"), F.col("item_pos"))
    pairs = F.array_distinct(F.flatten(F.collect_list(pair)))
    aligned = met.groupBy("doc_id", "text_hash", "item_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("places"), F.collect_set(same).alias("same"), pairs.alias("pairs"), F.max("need").alias("need"), F.max("total").alias("total"))
    own_only = ~_one_to_one(F.col("pairs")) & _half_kept(F.col("pairs"))
    if merged_values:
        own_only &= ~_function(F.col("pairs"))
    aligned = aligned.withColumn("clash", ~_one_to_one(F.col("pairs"))).withColumn("places", F.when(own_only, F.col("same")).otherwise(F.col("places")))
    enough = ~F.col("clash") | (F.size("places") >= CLASH_COVERAGE * F.col("total"))
    aligned = aligned.where((F.size("places") >= F.col("need")) & enough).withColumn("other", F.size("same") < F.size("places"))
    per = aligned.groupBy("doc_id", "text_hash", "item_id", "item_key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"), F.bool_or("other").alias("reparameterised"), F.max("total").cast("long").alias("item_windows"))
    per = per.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(F.col("coverage") >= min_coverage)
    return per.select("doc_id", "text_hash", "item_id", "n_windows", "item_windows", "coverage", "reparameterised")


def op1_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, one row for each document and item."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), merged_values=True)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("coverage").alias("coverage"), F.bool_or("reparameterised").alias("reparameterised"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item; contaminated ones go.

    Rows go by id and text, so another text of the same id stays. Null and empty texts stay.
    """
    bad = leaks(docs, read(spark, sf_dir, "benchmark"), merged_values=True).select(F.struct("doc_id", "text_hash").alias("bad")).distinct()
    mine = F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))
    return docs.join(bad, mine.eqNullSafe(bad["bad"]), "left_anti")
