"""The margin of a long clean text does not fall with its length."""

import itertools

from fixture_paths import SF
from pyspark.sql import functions as F

from genostrata.llm import lang_id
from genostrata.llm.common import held_out


def test_chunks_are_the_whole_text():
    for data in (b"", b"a b", b"word " * 70_000, b"x" * 200_000):
        parts = lang_id.chunks(data, lang_id.CHUNK_BYTES)
        assert b"".join(parts) == data and all(len(p) < 2 * lang_id.CHUNK_BYTES for p in parts)


def test_texts_of_millions_of_characters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.Classifier(lang_id.fit_dictionaries(docs, "text", "lang", ~held_out(F.col("doc_id"))))
    for lang in ("en", "fr"):
        texts = [r["text"] for r in docs.where((F.col("lang") == lang) & held_out(F.col("doc_id"))).orderBy("doc_id").collect()]
        joined, size = [], 0
        for t in itertools.cycle(texts):
            joined.append(t)
            size += len(t)
            if size > 6_000_000:
                break
        long = "\n".join(joined)
        found, _, margin, rejected = model.predict(long, lang_id.MIN_MARGIN)
        _, _, shorter, _ = model.predict(long[:200_000], lang_id.MIN_MARGIN)
        assert found == lang and not rejected and margin > 0.5 * shorter
