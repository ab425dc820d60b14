"""Operators that SQL cannot express, against plain versions written apart from them."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from fixture_paths import TINY
from pyspark.sql import functions as F

from genostrata.llm import decontaminate, fertility, lang_id, mixing, quality_model
from genostrata.llm.common import held_out

NUMBERED = "{name} buys {a} red apples and {b} green pears at the market near {place}, then walks {c} km home and shares all of them with four friends before dinner starts."
DENSE = "{a} + {b} = {c} km and {b} + {a} = {c} km"
SHORT = "Name the capital city"


def filled(template, rng):
    return template.format(name=rng.choice(["Anna", "Tomas", "Ingrid", "Pavel"]), place=rng.choice(["Oslo", "Turin", "Porto", "Gdansk"]), a=rng.randint(2, 30), b=rng.randint(31, 60), c=rng.randint(61, 99))


def plain_template(text):
    """Word by word: a number, a name inside a sentence, a unit after a number, or the word itself."""
    out, before = [], "."
    for w in text.split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        if re.fullmatch(r"\d+", core):
            kind = "<num>"
        elif core in ("km",) and out and out[-1] == "<num>":
            kind = "<unit>"
        elif re.fullmatch(r"[A-Z][a-z]+", core) and before[-1] not in ".!?:":
            kind = "<name>"
        else:
            kind = core.lower()
        if core:
            out.append(kind)
        before = w
    return out


def test_reparameterised_and_verbatim_copies_are_found(spark):
    rng = random.Random(3)
    items = [(1, "In the story " + filled(NUMBERED, rng)), (2, "A puzzle asks: " + filled(DENSE, rng)), (3, SHORT)]
    docs, want, truly_other = [], set(), set()
    for i in range(120):
        noise = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(5, 60)))
        kind = rng.randrange(4)
        body = ["In the story " + filled(NUMBERED, rng), items[1][1], SHORT, "nothing of note here"][kind]
        docs.append((i, f"{noise} . {body} {noise}"))
        if kind < 3:
            want.add((i, kind + 1))
        else:
            truly_other.add(i)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    # The plain version: does the item's whole template stand in the document's template?
    plain = set()
    for d, text in docs:
        t = plain_template(text)
        for i, item in items:
            p = plain_template(item)
            if any(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1)):
                plain.add((d, i))
    assert len(want & plain) == len(want)
    assert len(want & got) >= 0.95 * len(want) and not {d for d, _ in got} & truly_other


def test_slots_that_are_not_one_to_one(spark):
    item = "Lena packs 3 apples and 3 pears into the basket and carries them over the hill to her aunt who waits by the mill"
    texts = [
        item.replace("3 apples", "4 apples").replace("3 pears", "5 pears"),  # two equal numbers become different
        item.replace("3 pears", "9 pears"),  # one of two occurrences is edited, most windows stay
        "Lena packs 3 apples and 7 pears into the bag of a friend who likes to paint the sea at night",  # a few windows only
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0, 1}


@pytest.mark.parametrize("weights", [{"a": 0.9999, "b": 0.0001}, {"a": 1, "b": 1, "c": 1}, {"x": 0.5, "y": 0.3, "z": 0.2}])
def test_slot_by_slot_schedule(weights):
    share = {k: Fraction(w) / sum(map(Fraction, weights.values())) for k, w in weights.items()}
    n = 3000
    slots = mixing.block_slots(mixing.exact_units(weights), {k: n for k in weights})
    owner = {t: k for k, places in slots.items() for t in places}
    had = dict.fromkeys(weights, 0)
    for t in range(n):
        ready = {k: math.ceil((had[k] + 1) / share[k]) for k in weights if math.floor(had[k] / share[k]) <= t}
        k = min(ready, key=lambda k: (ready[k], k))
        assert owner[t] == k
        had[k] += 1
        assert all(abs(had[s] - share[s] * (t + 1)) < 1 for s in weights)


def test_fertility_measures(spark):
    import sentencepiece

    path = fertility.vocabulary_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{TINY}/documents.parquet").limit(60).collect()}
    rows = spark.createDataFrame([(i, *v) for i, v in docs.items()], "doc_id long, text string, lang string")
    for r in fertility.fertility_rules(rows, path=path).collect():
        text, lang = docs[r["doc_id"]]
        ids = model.encode(text)
        counts = {i: ids.count(i) for i in set(ids)}
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
        spelled = sum(c for i, c in counts.items() if model.is_byte(i) and model.id_to_piece(i) not in {f"<0x{ord(w):02X}>" for w in " \t\n\x0b\x0c\r"})
        assert r["chars_per_token"] == pytest.approx(len(text) / len(ids)) and r["token_entropy"] == pytest.approx(entropy) and r["byte_share"] == pytest.approx(spelled / len(ids))
        band = fertility.LANGUAGE_BANDS[lang]
        slack, short = fertility.SLACK / len(ids) ** 0.5, fertility.ENTROPY_SLACK / len(ids) ** 0.5
        fine = band.low - slack <= len(text) / len(ids) <= band.high + slack and spelled / len(ids) <= band.most_bytes and entropy >= band.least_entropy - short
        assert r["kept"] == (not r["base_failed"] and fine)


def test_a_missing_vocabulary_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    with pytest.raises(FileNotFoundError, match="nowhere"):
        fertility.fertility_rules(rows, path="/nowhere/x.model")


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(1)
    texts = ["good plain words in a row " * k + "tail" for k in range(1, 20)] + ["zz zz zz qq qq " * k for k in range(1, 20)]
    model = quality_model.train(texts, [1] * 19 + [0] * 19)
    model.weights = model.weights + rng.normal(0, 0.01, len(model.weights)).astype(np.float32)
    got = quality_model.Scorer(model).score([*texts, "", None, "unseen"])
    for text, score in zip([*texts, "", "", "unseen"], got, strict=True):
        rows = [r for w in text.split() for r in quality_model.features(w)]
        z = model.bias + sum(float(model.weights[r]) for r in rows) / (len(rows) + quality_model.SMOOTHING) if rows else model.bias
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_language_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    found = lang_id.fit_dictionaries(docs, "text", "lang", ~held_out(F.col("doc_id")))
    some = docs.limit(40)
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in lang_id.identify(some, found).collect():
        letters = "".join(c if c.isalpha() else " " for c in texts[r["doc_id"]].lower()).split()
        data = f" {' '.join(letters)} ".encode()
        if not letters:
            assert r["lang_pred"] == "und"
            continue
        sizes = {}
        for lang, content in sorted(found.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(lang_id.LEVEL, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(p)) for p in lang_id.chunks(data, lang_id.CHUNK_BYTES))
        low = sorted(sizes.values())
        assert r["lang_pred"] == min(sizes, key=lambda k: (sizes[k], k)) and r["margin"] == pytest.approx((low[1] - low[0]) / low[0])
