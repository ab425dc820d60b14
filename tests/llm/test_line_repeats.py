"""Lines of few words, exact repeats and near ones, and lines of scripts without blanks."""

import random

import pytest
from brute import lines_removed
from fixture_paths import SF

from genostrata.llm import line_dedup, queries

HAN = "今天的天气非常好我们一起去公园散步然后回家吃饭"
ROWS = [
    (1, "All rights reserved.\n\nbuy now buy now buy now\n" + HAN),
    (2, "ALL rights  reserved.\n\nbuy now buy now buy now\nreserved. All rights"),
    (3, HAN + "\n" + HAN.replace("吃饭", "吃面") + "\n完全不同的一行文字没有重复的内容在这里"),
    (4, "buy now\nAll rights reserved!\n"),
]


def removed(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in queries.QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}


def test_short_lines_are_sets_like_others(spark, tmp_path):
    got = removed(spark, tmp_path, ROWS)
    assert got[1] == (ROWS[0][1], 0)
    assert got[2] == ("", 3)
    assert got[4] == ("All rights reserved!\n", 1)


@pytest.mark.parametrize(("first", "second", "goes"), [("alpha beta gamma delta", "alpha beta gamma delta epsilon", True), ("alpha beta gamma delta epsilon", "alpha beta gamma delta", True), ("one two three", "two one three", True), ("one two three", "one two three four", False), ("a b c d", "a b c e", False), ("}", "}", True), ("x", "y", False)])
def test_pairs_of_short_lines(spark, first, second, goes):
    df = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: int(goes)}


def test_the_stage_takes_short_repeats_too(spark, tmp_path):
    df = spark.createDataFrame([(1, "All rights reserved.\nfirst text here"), (2, "second text there\nAll rights reserved."), (3, "All rights reserved.")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, df, str(tmp_path)).collect()} == {1: "All rights reserved.\nfirst text here", 2: "second text there"}


def test_lines_without_blanks(spark, tmp_path):
    got = removed(spark, tmp_path, ROWS)
    assert got[3] == ("完全不同的一行文字没有重复的内容在这里", 2)


def test_query_equals_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:300]
    rng = random.Random(8)
    short = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 7))) for _ in range(400)]
    rows += [(10_000 + i, "\n".join(short[i : i + 4])) for i in range(0, 400, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: len(v) for i, v in lines_removed(rows).items()}


def test_joins_beyond_what_is_broadcast(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:150]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.dedup_lines(df).collect()))
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    monkeypatch.setattr(line_dedup.small_enough, "__defaults__", (0,))
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect())) == want
