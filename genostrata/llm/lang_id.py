"""Language identification by compression.

Every language gets a zstandard raw-content dictionary cut from its own training texts.
A text is compressed in chunks with each dictionary; the language whose dictionary gives
the fewest bytes in all wins, and the text is rejected where the runner-up is nearly as
small. A dictionary saves a bounded number of bytes, so chunks keep the margin of a long text
from falling with its length.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.llm.common import add_text_columns, fresh, held_out, read

#: Texts sampled for each language (the least hash of each of so many hash ranges), the
#: longest text that is sampled, and the size of the dictionary cut from them. With very many
#: languages each has an equal part of ALL_DICTIONARIES bytes, which bounds what the driver
#: sends and a task holds.
TEXTS_PER_LANGUAGE = 256
LONGEST_SAMPLED = 20_000
DICTIONARY_BYTES = 1 << 17
ALL_DICTIONARIES = 1 << 26
#: So many times the dictionary's bytes are read for it, as texts shrink to their letters.
READ_AHEAD = 4
#: Up to so many sampled (language, hash) rows are broadcast.
MOST_BROADCAST = 100_000
LEVEL = 6
#: Bytes of text that a task turns into Python strings at a time.
SLICE_BYTES = 4 << 20
#: Bytes of normalised text compressed apart; a short last chunk goes with the one before.
CHUNK_BYTES = 1 << 15
#: Least (second smallest - smallest) / smallest compressed size that is not rejected.
MIN_MARGIN = 0.003
#: Softness of the score: weight exp(-SHARPNESS * extra bytes) of each language.
SHARPNESS = 0.5
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numerals and marks that count as word characters but are no letters, such as fractions.
_NO_LETTERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())

RESULT = "lang_pred string, score double, margin double, rejected boolean"


def normalise(text: str) -> bytes:
    """Lower-cased words of letters only, one space around each; empty without a letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words.isascii() and not _NO_LETTERS.isdisjoint(words):
        words = " ".join("".join(" " if c in _NO_LETTERS else c for c in words).split())
    return f" {words} ".encode("utf-8", "surrogatepass") if words else b""


def chunks(data: bytes, size: int) -> list[bytes]:
    """All of ``data`` in pieces of ``size`` to less than twice ``size`` bytes, cut at spaces where there are any."""
    found, at = [], 0
    while len(data) - at >= 2 * size:
        cut = data.find(b" ", at + size, at + size + 1024)
        cut = cut if cut > 0 else at + size
        found.append(data[at:cut])
        at = cut
    return [*found, data[at:]]


def fit_dictionaries(docs: DataFrame, text: str, lang: str, train: Column | None = None, *, texts_per_language: int = TEXTS_PER_LANGUAGE, longest_sampled: int = LONGEST_SAMPLED, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary content for each language, from a bounded hash sample of whole texts.

    The sample is the text of least hash in each of ``texts_per_language`` hash ranges of
    a language, so it does not depend on partitioning, and equal texts count once. Rows
    with a null text or language, rows outside ``train``, texts without a letter and
    texts beyond ``longest_sampled`` characters are not learned from. No rows, no languages.
    """
    rows = docs.where(train) if train is not None else docs
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where((F.length("text") <= longest_sampled) & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(texts_per_language)).alias("range")).agg(F.min("h").alias("h"))
    # At most ``texts_per_language`` rows of a language are left, of which few reach the driver.
    keys = chosen.select("lang", "h").limit(MOST_BROADCAST + 1).collect()
    if not keys:
        return {}
    small = chosen.select("lang", "h")
    if len(keys) <= MOST_BROADCAST:  # narrow rows of a counted number; beyond it both sides are shuffled
        small = F.broadcast(docs.sparkSession.createDataFrame([tuple(k) for k in keys], "lang string, h long"))
    texts = rows.join(small, ["lang", "h"]).dropDuplicates(["lang", "h"])
    before = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    texts = texts.where(F.col("before") < READ_AHEAD * dictionary_bytes)
    by_lang: dict[str, bytes] = {}
    for r in texts.select("lang", "h", "text").repartitionByRange(8, "lang", "h").sortWithinPartitions("lang", "h").toLocalIterator():
        if len(had := by_lang.get(r["lang"], b"")) < dictionary_bytes:
            by_lang[r["lang"]] = (had + normalise(r["text"]))[:dictionary_bytes]
    most = min(dictionary_bytes, ALL_DICTIONARIES // max(1, len(by_lang)))
    return {k: v[:most] for k, v in by_lang.items() if len(v[:most]) >= 8}


class Classifier:
    """Compresses with every dictionary; built once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(dictionaries[lang]), write_checksum=False, write_content_size=False, write_dict_id=False)
            content.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, float, bool]:
        data = normalise(text) if text else b""
        if not data or not self.coders:
            return UNDETERMINED, 0.0, 0.0, True
        parts = chunks(data, CHUNK_BYTES)
        sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in self.coders], float)
        best = int(sizes.argmin())  # of equal sizes the first language in order
        score = 1.0 / np.exp(-SHARPNESS * (sizes - sizes[best])).sum()
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0, False
        margin = float((np.partition(sizes, 1)[1] - sizes[best]) / sizes[best])
        return self.langs[best], float(score), margin, margin < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",), *, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``keep`` columns plus lang_pred, score (0 to 1), margin and rejected, row by row.

    A null text, a text without a letter, or no dictionary at all gives ``und``, score 0,
    margin 0 and rejected. Ties go to the first language in order, with margin 0. Texts of
    any length are read whole, in chunks of CHUNK_BYTES. Repeated rows are each answered; other columns of
    ``docs`` are not read.
    """
    (whole,) = fresh(keep, "text")
    return _judged(docs.select(*keep, F.col(text).alias(whole)), whole, dictionaries, min_margin, keep_text=False)


def _judged(rows: DataFrame, text: str, dictionaries: dict[str, bytes], min_margin: float, *, keep_text: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        model = Classifier(shared.value)
        return lambda texts: list(zip(*(model.predict(t, min_margin) for t in texts), strict=True)) or [[]] * 4

    return add_text_columns(rows, text, make, RESULT, keep_text=keep_text, slice_bytes=SLICE_BYTES)


def op9_compression_langid(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every document."""
    docs = read(spark, sf_dir, "documents")
    model = fit_dictionaries(docs, "text", "lang", ~held_out(F.col("doc_id")))
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(rows, model, keep=("doc_id", "held_out"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; rejected ones go.

    Every row is judged by its own text, so repeated rows and ids stay or go alike; null
    texts and texts without a letter go, null ids do not matter. Columns of any name pass
    through.
    """
    model = fit_dictionaries(docs, "text", "lang", ~held_out(F.col("doc_id")))
    # Columns travel by number, so their names cannot clash with those of the result, and the text only once.
    numbered = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    kept = _judged(docs.select(*numbered), f"c{next(i for i, c in enumerate(docs.columns) if c.lower() == 'text')}", model, MIN_MARGIN, keep_text=True).where(~F.col("rejected"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
