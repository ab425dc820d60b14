"""Re-parameterised copies whose new values happen to be equal, many rows of one id, and passes of the pipeline."""

import random

from fixture_paths import TINY

import corpus_pipeline
from genostrata.llm import decontaminate, near_dedup, queries

ITEM = "if a man buys {} pens and {} cups how many things does he own"


def found(spark, texts, item, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), **how).collect()}


def test_new_values_that_are_equal(spark):
    texts = [ITEM.format(*v) for v in ((5, 5), (4, 4), (8, 9), (3, 3), (5, 3), (3, 5))] + ["if a man sells 5 cups and 5 pens he has nothing left to count or to own at all"]
    assert found(spark, texts, ITEM.format(3, 5), merged_values=True) == {0, 1, 2, 3, 4, 5}
    assert 0 not in found(spark, texts, ITEM.format(3, 5))


def test_recall_of_planted_copies_with_few_values(spark, tmp_path):
    rng = random.Random(4)
    item = "Rita keeps {} hens , {} ducks and {} geese in the yard and wants to know how many birds there are after {} more come"
    rows, want = [], set()
    for i in range(200):
        noise = " ".join(f"w{rng.randint(0, 999)}" for _ in range(40))
        copy = i % 2 == 0
        body = item.format(*(rng.randint(1, 4) for _ in range(4))) if copy else noise
        rows.append((i, f"{noise} . {body} {noise}"))
        want |= {i} if copy else set()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item.format(2, 3, 4, 5))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in queries.QUERIES["op1_template_decontamination"](spark, str(tmp_path)).collect()} == want
    kept = decontaminate.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == set(range(200)) - want


def test_rows_that_share_an_id_meet_their_own_class_only(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(1000):
        text = rng.sample(words, 40)
        rows += [(None if i % 2 else 7, " ".join(text)), (None if i % 2 else 7, " ".join(text) + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = df.select(F.monotonically_increasing_id().alias("cls"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.lit(0).alias("hi"), F.lit(0).alias("lo"))
    assert near_dedup.candidate_texts(df, "doc_id", "text", wanted).count() == 2000
    got = near_dedup.near_duplicates(df, width=4)
    assert got.count() == 2000 and near_dedup.stage(spark, df, "").count() == 1000


def test_each_stage_is_computed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counting(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return docs.mapInArrow(run, docs.schema)

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("count", counting), *stages])
    corpus_pipeline.run(spark, TINY).count()
    assert seen.value == spark.read.parquet(f"{TINY}/documents.parquet").count()
    seen.value = 0
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], ("count", counting), *stages[1:]])
    corpus_pipeline.run(spark, TINY).count()
    assert 0 < seen.value <= spark.read.parquet(f"{TINY}/documents.parquet").count()
