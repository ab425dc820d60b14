"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from brute import components, lines_removed
from pyspark.sql import functions as F

import corpus_pipeline
from genostrata.llm import chat, credential_scan, decontaminate, fertility, lang_id, line_dedup, mixing, near_dedup, quality_model, url_lists

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __text string, h int, cls string, d string, slot string, key string, label string, found string"
WORDS = "the old river runs past a quiet mill where children count smooth stones and sing of ships that never came home again".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def awkward(spark):
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 80), "en", "a"), (2, prose(2, 80), "en", "a"), (2, prose(2, 80), "en", "a"), (3, None, "en", None), (4, "", None, "b"), (None, prose(3, 70), None, None),
        (None, None, None, None), (5, long, "fr", "b"), (6, long + " tail", "fr", "b"), (7, " \t\n ", "xx", ""), (8, "\U0001d4b3é 漢字 — …", "xx", "a"), (9, "one", "en", "a"), (10, "ONE", "en", "a"), (11, "12 34 !!", "en", "a"),
    ]
    extra = ("x", 1, "c", "d", "s", "k", "l", "f")
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *extra) for i, t, g, s in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark):
    model = lang_id.fit_dictionaries(awkward(spark), "text", "lang")
    assert "xx" not in model or model["xx"]
    got = lang_id.identify(awkward(spark), model, keep=("doc_id", "h")).collect()
    assert len(got) == 14
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und >= {3, 4, 7, 11} and all(r["rejected"] and r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert lang_id.fit_dictionaries(empty(spark), "text", "lang") == {}
    assert {r["lang_pred"] for r in lang_id.identify(awkward(spark), {}).collect()} == {"und"}
    assert lang_id.identify(empty(spark), model).count() == 0
    only = lang_id.identify(awkward(spark), {"en": model["en"]}).where("doc_id = 1").first()
    assert only["lang_pred"] == "en" and only["score"] == 1


def test_fertility(spark):
    got = fertility.fertility_rules(awkward(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 14 and by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"] and by[3]["token_entropy"] == 0
    assert by[5]["n_words"] == 60_000
    assert fertility.fertility_rules(empty(spark)).count() == 0
    assert fertility.script_of("привет мир") == "cyrillic" and fertility.script_of("漢字") == "other" and fertility.script_of("é a") == "latin" and fertility.script_of("1") == "other"


def test_quality(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (9, None, 0), (None, 1, 0), (99, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(awkward(spark), labels, "doc_id", "text", "quality", F.lit(True))
    got = quality_model.score_quality(awkward(spark), model, keep=("doc_id", "h")).collect()
    assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (3, 4, 7)}
    assert len(blank) == 1
    none = quality_model.fit(empty(spark), labels.limit(0), "doc_id", "text", "quality", F.lit(True))
    assert {r["score"] for r in quality_model.score_quality(awkward(spark), none).collect()} == {0.5}
    assert quality_model.score_quality(empty(spark), none).count() == 0


def test_near_duplicates(spark):
    got = near_dedup.near_duplicates(awkward(spark), width=4)
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()}
    assert got.count() == 14
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[2][2] == 1 and by[6][2] == 5 and by[10][2] == 9 and by[3][1] == 0 and by[3][3] and by[7][2] == 7
    assert (None, 0, None, True) in rows
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    assert near_dedup.near_duplicates(awkward(spark).where("doc_id IN (3, 4)")).where("kept").count() == 2


def test_near_copies_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    docs = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(words)))
    want = components(docs, 4, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()}
    assert got == want and len(set(want.values())) > 1


def test_lines(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta gamma delta epsilon zeta eta theta iota NEW"
    rows = [(1, a + "\nshort line\n" + a), (2, b + "\nshort line"), (2, b + "\nshort line"), (3, None), (4, ""), (5, "\n\n"), (6, a.upper() + "\tkappa"), (None, a + " lambda"), (7, "\n".join(prose(i, 30) for i in range(2000)))]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, cls string, n_lines int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "cls", "n_lines", "n_removed"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 9
    assert by[None]["n_removed"] == 0  # a null id comes first
    assert by[1]["text"] == "short line" and by[2]["text"] == "" and by[6]["text"] == ""
    assert by[3]["text"] is None and by[3]["n_lines"] == 0 and by[4]["text"] == "" and by[4]["n_lines"] == 1 and by[5]["text"] == "\n\n"
    assert by[7]["n_removed"] == len(lines_removed([(7, rows[-1][1])])[7])
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_near_lines_of_near_lines(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(words)))
    want = lines_removed(docs)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: len(v) for i, v in want.items()} and 0 < sum(got.values()) < 149


def test_secrets(spark):
    rows = [(1, "user_name: bob then password=abc12 at https://x.y.com/z"), (2, "password=abc12"), (3, None), (4, ""), (5, "é\U0001d4b3 AKIA" + "A" * 12), (None, "login=joe secret: token = abcdefghij"), (6, "login=joe" + " " * 400 + "pwd=abcdefg"), (7, "token=abcd1234 " * 20_000), (7, "token=abcd1234 " * 20_000)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, rid int, kind string")
    got = credential_scan.scan(df).collect()
    by = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["strong"]) for s in r["found"]] for r in got}
    assert len(got) == 9 and [s[0] for s in by[1]] == ["user", "assign", "endpoint"] and not any(s[3] for s in by[1])
    assert by[2] == by[3] == by[4] == by[6] == [] and by[5] == [("access", 3, 19, True)] and len(by[7]) == 20_000
    assert credential_scan.scan(df.limit(0)).count() == 0


def test_decontamination(spark):
    q = "Maria has 12 apples and gives 5 of them to her brother before walking 3 km to the old market near Oslo today."
    other = q.replace("12", "40").replace("5 of", "9 of").replace("Oslo", "Turin").replace("3 km", "8 km")
    mixed = "we walk 3 km to the old mill and then 7 km to the sea and back home by boat"
    rows = [(1, "Intro text here. " + q + " More text."), (2, "Intro text here.\n" + other), (3, prose(5, 500)), (4, None), (5, ""), (None, q), (1, "Intro text here. " + q + " More text."), (6, prose(6, 30_000) + " . " + q), (7, mixed.replace("7 km", "3 km"))]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, item_id int, hash string")
    items = spark.createDataFrame([(1, q, 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (5, q, 0), (6, mixed, 0)], "item_id long, text string, hash int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, items).collect()}
    assert got.keys() == {(i, k) for i in (1, 2, 6, None) for k in (1, 5)}
    assert got[2, 1]["reparameterised"] and not got[1, 1]["reparameterised"]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, prose(1, 50)), (2, prose(2, 50))], "doc_id long, text string")
    items = spark.createDataFrame([(9, prose(1, 50))], "item_id long, text string")
    want = [tuple(r) for r in decontaminate.leaks(docs, items).collect()]
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 3)
    assert [tuple(r) for r in decontaminate.leaks(docs, items).collect()] == want and want[0][0] == 1


def test_mixing(spark):
    rng = random.Random(2)
    units = mixing.whole_units({f"s{i}": rng.random() + 0.01 for i in range(9)}, 1000)
    period = sum(units.values())
    slots = mixing.earliest_deadline_first(units)
    assert sorted(x for s in slots.values() for x in s) == list(range(period))
    for k, places in slots.items():
        for b, t in enumerate(places):  # within release and deadline
            assert b * period // units[k] <= t < -(-(b + 1) * period // units[k])
        had = 0
        for t in range(period):
            assert abs(had - t * units[k] / period) < 1
            had += t in places
    got = mixing.mix(awkward(spark), block_docs=2)
    assert got.count() == 14 and got.select("slot", "in_block").distinct().count() == 14
    assert mixing.mix(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="no target weight"):
        mixing.mix(awkward(spark), weights={"a": 1.0})
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(awkward(spark), weights={"a": 1, "b": 0, "": 1, None: 1})
    assert mixing.mix(awkward(spark), weights={"a": 3, "b": 1, "": 1, None: 1}).count() == 14


def test_weights_hold_while_all_sources_last(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source"))
    first = mixing.mix(df, weights={"big": 1, "small": 3}, block_docs=10).where("slot < 1000").groupBy("source").agg(F.countDistinct("slot").alias("n"))
    assert {r["source"]: r["n"] for r in first.collect()} == {"big": 250, "small": 750}


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "<|im_end|> x"), (4, 0, None, None), (4, 0, None, None), (5, 0, "user", "other"), (6, 0, "user", "other"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, n int, k string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got.keys() == {3, 4, 5, None} and got[5]["n_copies"] == 2 and got[4]["n_turns"] == 1
    assert got[3]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n< |im_end|> x<|im_end|>\n"
    assert got[4]["rendered"] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_urls(spark):
    entries = [("Bad.com", "add", "2024-01-10"), ("bad.com", "remove", "2024-02-10"), ("bad.com", "add", "2024-01-20"), ("ok.bad.com", "add", "2024-03-01"), ("x.org", "remove", "2024-01-01"), (None, "add", "2024-01-01"), ("y.org", "odd", "2024-01-01"), ("z.org", "add", "2024-01-05"), ("z.org", "remove", "2024-01-05")]
    e = spark.createDataFrame([(*x, 1) for x in entries], "domain string, action string, day string, host int")
    urls = [(1, "http://www.bad.com:80/a", "2024-01-09"), (2, "https://u@a.bad.com/", "2024-01-10"), (3, "http://bad.com", "2024-02-10"), (4, "http://ok.bad.com./x", "2024-03-02"), (5, None, "2024-01-11"), (6, "nonsense", "2024-01-11"), (7, "http://bad.com", None), (2, "https://u@a.bad.com/", "2024-01-10"), (8, "http://notbad.com", "2024-01-11"), (9, "http://z.org/", "2024-01-05")]
    c = spark.createDataFrame([(*x, "d") for x in urls], "page_id long, url string, fetched string, domain string")
    got = url_lists.judge(c, e, "page_id", "url", "fetched").collect()
    assert len(got) == 10
    assert {r["capture_id"]: r["listed_domain"] for r in got} == {1: None, 2: "bad.com", 3: None, 4: "ok.bad.com", 5: None, 6: None, 7: None, 8: None, 9: "z.org"}
    assert url_lists.judge(c.limit(0), e, "page_id", "url", "fetched").count() == 0
    assert url_lists.judge(c, e.limit(0), "page_id", "url", "fetched").where("blocked").count() == 0


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    for n, rows in enumerate((awkward(spark), empty(spark))):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars")
        folder = tmp_path / str(n)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, prose(2, 80))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        ids = [r["doc_id"] for r in out]
        assert not {1, 3, 4, 7, 11} & set(ids) and len(ids) == len(set(ids))
