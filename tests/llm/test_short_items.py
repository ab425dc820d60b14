"""Benchmark items of few literals, dense with numbers, or in scripts without blanks."""

from genostrata.llm import decontaminate

ITEMS = [
    (1, "What is 17 times 23?"),
    (2, "7 kg 9 kg 11 kg fit 4 m 5 m 6 m into 8 s 12 s 13 s one 21 g 22 g 23 g large 31 l 32 l 33 l wooden 41 h 42 h 43 h box"),
    (3, "小明有十二个苹果他给了妹妹五个请问还剩几个"),
    (4, "Compute 3 + 4"),
]
TEXTS = [
    (1, "First. What is 17 times 23? Then more."),
    (2, "What is 17 times 24?"),
    (3, "note: " + ITEMS[1][1] + " end"),
    (4, "note: " + ITEMS[1][1].replace("7 kg", "70 kg").replace("33 l", "34 l") + " end"),
    (5, "问题：" + ITEMS[2][1] + "。谢谢"),
    (6, "Compute 3 - 4 and what is 17"),
    (7, "times 23? What is 17 compute 3 + 4."),
]


def test_items_without_a_usual_window(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, items).collect()}
    assert got.keys() == {(1, 1), (3, 2), (4, 2), (5, 3), (7, 4)}
    assert got[4, 2]["reparameterised"] and not got[3, 2]["reparameterised"] and not got[1, 1]["reparameterised"]
    assert all(got[k]["coverage"] == 1 for k in ((1, 1), (3, 2), (5, 3), (7, 4)))


def test_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 1)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == want
