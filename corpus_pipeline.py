"""From documents to a training mixture: each stage works on what the one before it kept."""

from genostrata.llm import decontaminate, lang_id, line_dedup, mixing, near_dedup
from genostrata.llm.common import Scratch

STAGES = [
    ("language_id", lang_id.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mix_to_target_weights", mixing.stage),
]

ORACLE_SQL = None  # compression, MinHash and scheduling are beyond SQL; tests hold it against brute force


def run(spark, sf_dir):
    """The rows of the last stage over the documents in ``sf_dir``.

    Each stage's rows are written to the shared folder once, since a stage may read them
    several times; they go when the next stage's are written, but for those that the last
    stage's result still reads.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    with Scratch(spark) as before:
        for at, (_, stage) in enumerate(first):
            with Scratch(spark) as mine:
                docs = mine.table(stage(spark, docs, sf_dir), keep=at == len(first) - 1)
                before.paths, mine.paths = mine.paths, before.paths
    return last(spark, docs, sf_dir)
