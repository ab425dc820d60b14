"""Queries over the small tables: against SQL, or against plain versions."""

import hashlib

import pytest
from brute import base_spans, components, held_out, lines_removed, word_rules
from fixture_paths import SF, TINY
from oracle import same

import __spark_entry__ as entry
import corpus_pipeline
from genostrata.llm import line_dedup, mixing, near_dedup, queries


def docs(spark, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def test_all_ten_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf_dir", [TINY, SF])
def test_equals_sql(spark, name, sf_dir):
    same(spark, queries.QUERIES[name], queries.ORACLES[name], sf_dir)


def test_decontamination_finds_whole_items(spark):
    import re

    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    texts = {d["doc_id"]: norm(d["text"]) for d in docs(spark)}
    items = {b["item_id"]: norm(b["text"]) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for i, x in items.items() for d, t in texts.items() if x in t}
    assert {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op1_template_decontamination"](spark, SF).collect()} == want


def test_mixing_places_every_document_once(spark):
    got = queries.QUERIES["op2_pfair_mixing"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs(spark))
    assert len({(r["slot"], r["in_block"]) for r in got}) == len(got)
    slots = {r["slot"]: (r["source"], r["block"]) for r in got}
    assert sorted(slots) == list(range(len(slots)))
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    plan = mixing.phases(mixing.whole_units({k: n**0.5 for k, n in sizes.items()}, 1000), {k: -(-n // 64) for k, n in sizes.items()})
    for source, parts in plan.items():
        for first, nxt, units, offset, period, places in parts:
            for k in range(first, nxt):
                j = k - first
                assert slots[offset + j // units * period + places[j % units]] == (source, k)


def test_base_secrets(spark):
    texts = {d["doc_id"]: d["text"] for d in docs(spark)}
    for r in queries.QUERIES["op4_credential_linking"](spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(base_spans(texts[r["doc_id"]]).encode()).hexdigest()


def test_fertility_counts(spark):
    texts = {d["doc_id"]: d["text"] for d in docs(spark, TINY)}
    labels = dict(spark.read.parquet(f"{TINY}/labels.parquet").select("doc_id", "quality").collect())
    good = 0
    for r in queries.QUERIES["op5_token_fertility"](spark, TINY).collect():
        want = word_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if labels.get(r["doc_id"]) == 1 and not r["base_failed"]:
            good += 1
            assert r["kept"]
    assert good > 20


def test_quality_on_held_out_rows(spark):
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rows = queries.QUERIES["op6_subword_quality"](spark, SF).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    out = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in out) / len(out) > 0.9


def test_near_duplicates_equal_all_pairs(spark):
    rows = [(d["doc_id"], d["text"]) for d in docs(spark)]
    want = components(rows, 4, 80)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in queries.QUERIES["op8_minhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (c, c == i) for i, c in want.items()}


def test_language_on_held_out_rows(spark):
    langs = {d["doc_id"]: d["lang"] for d in docs(spark)}
    rows = queries.QUERIES["op9_compression_langid"](spark, SF).collect()
    assert len(rows) == len(langs) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(out) / len(out) > 0.95


def test_line_dedup_equals_all_pairs(spark):
    rows = [(d["doc_id"], d["text"]) for d in docs(spark)][:300]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = lines_removed(rows)
    for r, (_, text) in zip(line_dedup.dedup_lines(df).orderBy("doc_id").collect(), sorted(rows), strict=True):
        lines = text.split("\n")
        assert r["n_lines"] == len(lines) and r["n_removed"] == len(want[r["doc_id"]])
        assert r["text"] == "\n".join(x for k, x in enumerate(lines) if k not in want[r["doc_id"]])


def test_pipeline_stages_take_effect(spark, tmp_path):
    df = spark.read.parquet(f"{TINY}/documents.parquet")
    names = df.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, TINY)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        before = {r["doc_id"] for r in df.collect()}
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        assert kept.keys() <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names
        if k == 1:
            plain = {r["doc_id"]: r["text"] for r in df.collect()}
            gone = lines_removed(list(plain.items()))
            want = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in plain.items()}
            assert kept == {i: t for i, t in want.items() if t.split() or not gone[i]}
        if k == 2:
            want = components([(r["doc_id"], r["text"]) for r in df.collect()], 5, 80)
            assert kept.keys() == {i for i, c in want.items() if i == c}
        df = after
    assert {"block", "slot", "in_block"} <= set(df.columns)
    again = corpus_pipeline.run(spark, TINY)
    assert sorted((r["doc_id"], r["slot"]) for r in again.select("doc_id", "slot").collect()) == sorted((r["doc_id"], r["slot"]) for r in df.select("doc_id", "slot").collect())


def test_signature_bound():
    from math import comb

    missed = sum(comb(near_dedup.K, i) * 0.8**i * 0.2 ** (near_dedup.K - i) for i in range(near_dedup.MATCHES))
    assert missed < 1e-5
