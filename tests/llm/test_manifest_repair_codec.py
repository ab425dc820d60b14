"""Merkle manifests, conversation repair and the BPE codec against plain versions."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from fixture_paths import TINY
from pyspark.sql import functions as F

from genostrata.llm import bpe, merkle, queries, repair
from genostrata.llm.common import Scratch

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(nodes):
    """Levels of runs, and the root, of a list of digests."""
    levels = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        levels.append(runs)
        nodes = [H(*r) for r in runs]
    return levels, nodes[0]


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, text, lang, source, n_chars), in order."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*map(show, (r[0], r[3], r[2], r[4], t)))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        hurt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), leaf(r, lower(r[1]) if hurt else r[1]), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g])]) for g in order}
    above, root = plain_tree([trees[g][1] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (_, own, other, doc_id) in enumerate(sorted(groups[g])):
            siblings, folded = "", other
            for levels, place in ((trees[g][0], i), (above, at)):
                for runs in levels:
                    run, k = runs[place // 8], place % 8
                    siblings += "".join(run[:k] + run[k + 1 :])
                    folded = H(*run[:k], folded, *run[k + 1 :])
                    place //= 8
            out.append((doc_id, own, trees[g][1], root, H(siblings), folded, folded == root))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, digest string"


def documents(n, langs, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("abcDEé ") for _ in range(rng.randint(0, 40))), rng.choice(langs), rng.choice(["x", None]), i) for i in range(n)]
    return rows + [(None, "A", langs[0], "x", 1), (None, None, None, None, None), rows[3], rows[3]]


def saved(spark, rows, path, schema=DOCS):
    spark.createDataFrame([(*r, "t", 1, "d") for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize(("n", "langs"), [(5, ["en"]), (700, ["en", "de", None, "", "é"]), (90, [f"l{i}" for i in range(70)])])
def test_manifest_equals_a_plain_tree(spark, tmp_path, n, langs):
    rows = documents(n, langs, n)
    got = as_rows(merkle.op11_merkle_manifest(spark, saved(spark, rows, tmp_path)))
    assert got == sorted(plain_manifest(rows), key=repr)
    assert n < 90 or len({r[6] for r in got}) == 2


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = merkle.op11_merkle_manifest(spark, saved(spark, [(1, "Ab", None, "s", 2)], tmp_path / "1")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == H("")
    assert merkle.op11_merkle_manifest(spark, saved(spark, [], tmp_path / "0")).count() == 0


def test_open_children_meet_in_later_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_LEFT", 3)  # lifts a few levels a round instead of dealing whole trees
    n = 5000
    leaves = spark.range(n).repartition(7).select(F.lit("=a").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("id").alias("idx"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    with Scratch(spark) as scratch:
        nodes = merkle.tree_nodes(leaves, scratch)
        levels, root = plain_tree([H(str(i)) for i in range(n)])
        assert nodes.where("kind = 'root'").select("digest").first()[0] == root
        assert nodes.where("kind = 'node'").count() == sum(map(len, levels))


WORDS = ["a.", "b!", "c", "d? ", "", " \t", "same.", "same."]


def plain_repair(rows):
    """(cost, audit, turns) by trying every string of edits over (role, text, fault), with few inserts."""
    best = None
    grammar = lambda s: s == "" or (s.removeprefix("s") != "" and s.removeprefix("s") == "ua" * (len(s.removeprefix("s")) // 2))
    choices = []
    for role, text, fault in rows:
        late = 5 if fault == "truncated" else 0
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", late, (role, text)), ("R", 1 + late, ("user", text)), ("R", 1 + late, ("assistant", text))]
        choices.append(own)
    puts = [[]] + [[("I", 5, (r, ""))] for r in ("user", "assistant")] + [[("I", 5, ("user", "")), ("I", 5, ("assistant", ""))]]
    for own in product(*choices):
        base = sum(c for _, c, _ in own)
        if best and base > best[0]:
            continue
        for where in product(puts, repeat=len(own) + 1):
            edits = [*where[0], *(e for o, w in zip(own, where[1:], strict=True) for e in (o, *w))]
            cost = sum(c for _, c, _ in edits)
            key = (cost, "".join(e for e, _, _ in edits))
            if (not best or key < best[:2]) and grammar("".join((t[0][:1] or "?") for _, _, t in edits if t)):
                best = (*key, [t for _, _, t in edits if t])
    return best


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(1)
    for _ in range(120):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(WORDS)) for _ in range(rng.randint(0, 4))]
        conv = repair.Conversation(True)
        for i, (role, text) in enumerate(rows):
            conv.add(i, role, text)
        way = conv.end()
        cost, audit, left = plain_repair(faults(rows))
        assert (way.cost, "".join(repair.whole(way.audit))) == (cost, audit)
        assert [t[1:] for part in repair.whole(way.turns) for t in part] == left
        assert way.digest.hexdigest() == H("\n".join(f"{r}:{t}" for r, t in left))


def test_segments_equal_the_whole(monkeypatch):
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice([*WORDS, f"x{i}.", f"y{i}"])) for i in range(rng.randint(0, 60))]
        found = []
        for size in (10**6, rng.choice([1, 2, 5, 9])):
            monkeypatch.setattr(repair, "SEGMENT", size)
            conv = repair.Conversation(True)
            for i, (role, text) in enumerate(rows):
                conv.add(i, role, text)
            way = conv.end()
            found.append((way.cost, "".join(repair.whole(way.audit)), way.digest.hexdigest(), [t for part in repair.whole(way.turns) for t in part]))
        assert found[0] == found[1]


def test_repair_of_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first?"), (1, 0, "assistant", "x."), (None, 2, "user", "hm."), (None, 9, "assistant", "so."), (2, 5, "user", "\U0001d4b3é."), (2, 5, "user", "\U0001d4b3é."), (2, 7, "assistant", "word " * 200_000 + "end.")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, place int")
    got = {r["conv_id"]: r for r in repair.repair_report(df).collect()}
    assert got[1]["audit"] == "KDK" and got[1]["blank"] == 1 and got[1]["gaps"] == 0 and got[1]["illegal"] == 2
    assert got[None]["audit"] == "KK" and got[None]["gaps"] == 6
    assert got[2]["audit"] == "KDK" and got[2]["duplicate"] == 1 and got[2]["gaps"] == 1
    gone = repair.repair_report(df, gone=F.col("conv_id") == 2).where("conv_id = 2").first()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", H(""))
    turns = repair.repaired_turns(df).where("conv_id = 1").orderBy("place").collect()
    assert [(t["edit"], t["role"], t["text"]) for t in turns] == [("K", "user", "first?"), ("K", "assistant", "x.")]
    assert repair.repair_report(df.limit(0)).count() == 0


def test_codec_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    model = Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    texts += [None, "", "<|endoftext|> a <|endoftext|>", "a" * 5000, " \n\n  x  ", "it's we'll I'M", "漢字 ١٢ ½", "՘ a՘ ՘!", "é \x00 　x"]
    rows = [(i, t, 7, "b") for i, t in enumerate(texts)] + [(0, texts[0], 7, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op13_bpe_codec"](spark, str(tmp_path)).collect():
        ids = model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(bpe.pack_ids(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(df).columns == ["doc_id", "ids", "n_tokens"] and bpe.encode(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, bytearray(bpe.pack_ids([50_256, 222, 60_000]))), (2, None)], "n long, ids binary")
    assert [r["text"] for r in bpe.decode(odd).orderBy("n").collect()] == ["<|endoftext|>" + model.decode([222]), ""]


def test_codec_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    model, own = Tokenizer.from_file(path), bpe.Vocabulary(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80), st.lists(st.integers(0, 50_256), max_size=20))
    def holds(text, ids):
        found = own.encode(text)
        assert list(bpe.unpack_ids(found)) == model.encode(text, add_special_tokens=False).ids
        assert own.decode(found) == text
        assert own.decode(bpe.pack_ids(ids)) == model.decode(ids, skip_special_tokens=False)

    holds()


def test_long_texts_are_cut_between_words(monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    own, model = bpe.Vocabulary(path), Tokenizer.from_file(path)
    text = "words and   more\n\n words's 12 " * 50 + "x" * 300 + "  "
    monkeypatch.setattr(bpe, "PIECE", 10)
    assert list(bpe.unpack_ids(own.encode(text))) == model.encode(text, add_special_tokens=False).ids


def test_an_unfit_vocabulary_is_an_error(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(FileNotFoundError):
        bpe.Vocabulary("/nowhere/x.json")
