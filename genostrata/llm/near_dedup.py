"""MinHash near-duplicate detection by a join on signature coordinates.

A document is posted under each (coordinate, value) pair of its signature, and documents
that agree on enough coordinates are compared on their full shingle sets. Documents of
equal sets are one class and join as one. Three things keep this from growing with the
square of a group of near copies, without losing a link:

* prefix: a pair that agrees on MATCHES of K coordinates shares one of the K - MATCHES + 1
  rarest postings of either, so a class is looked up under those only;
* hubs first: every class of a posting list is compared with two hubs of the list, which
  joins most of a group of near copies by a number of pairs linear in its size;
* skip: afterwards only lists that still hold more than one component are merged, in
  blocks of bounded size, and of the pairs that agree only those that join components come
  back. What these join is compared on full sets, again in blocks and only across
  components.

A link is missed only if two sets of similarity 0.8 agree on fewer than MATCHES of K
coordinates, of probability below 1e-5; links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import Scratch, add_text_columns, ascii_words, mix64, read, window_hashes, word_hashes
from genostrata.llm.components import connected_components

#: Coordinates of a signature, and how many a candidate pair must agree on.
K, MATCHES = 64, 36
PREFIX = K - MATCHES + 1
#: Classes in each side of a block of a long posting list.
BLOCK = 1024
#: The same where full sets are compared.
SET_BLOCK = 256
#: Bytes in each side of a block; a single set beyond it is a block of its own.
BLOCK_BYTES = 64 << 20
#: Parts that the classes of one component are dealt to when they learn its least id.
SALTS = 16

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)
_COORDINATE = mix64(np.arange(1, K + 1, dtype=np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word windows; the whole sequence if it is shorter."""
    words = word_hashes(ascii_words(text)) if text else np.empty(0, np.uint64)
    if len(words) == 0:
        return words
    return np.unique(window_hashes(words, min(width, len(words))))


def signature(s: np.ndarray) -> np.ndarray:
    """K keys, each a hash of a coordinate and the least value of the set there."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return mix64(low ^ _COORDINATE).view(np.int64)


def sketch(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, hi, lo (a 128-bit digest of the set) and sig of every row."""

    def make():
        def apply(texts):
            n, hi, lo, sig = [], [], [], []
            for t in texts:
                s = shingles(t, width)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                n.append(len(s))
                hi.append(digest[0])
                lo.append(digest[1])
                sig.append(signature(s) if len(s) else None)
            return n, hi, lo, sig

        return apply

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return add_text_columns(rows, "text", make, "n_shingles bigint, hi bigint, lo bigint, sig array<bigint>")


def posting_lists(reps: DataFrame) -> DataFrame:
    """(key, cls, n, singles): classes under their rarest keys, those nobody shares left out."""
    posts = reps.select("cls", "n", F.explode("sig").alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    found = posts.join(shared, "key").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    found = found.withColumn("singles", F.lit(K) - F.size("keys")).where(F.col("singles") < PREFIX)
    rarest = F.slice("keys", F.lit(1), F.lit(PREFIX) - F.col("singles"))
    return found.select("cls", "n", "singles", F.explode(rarest).alias("p")).select("p.key", "cls", "n", "singles")


def _alike_in_size(x, y, percent: int):
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def hub_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class of a list with its most ordinary class and with its first class."""
    hubs = posts.groupBy("key").agg(F.min(F.struct("singles", "cls", "n")).alias("h1"), F.min(F.struct("cls", "n")).alias("h2"))
    hubs = hubs.select("key", F.explode(F.array(F.struct("h1.cls", "h1.n"), F.struct("h2.cls", "h2.n"))).alias("h")).distinct()
    pairs = posts.join(hubs, "key").where((F.col("cls") != F.col("h.cls")) & _alike_in_size(F.col("n"), F.col("h.n"), percent))
    return pairs.select(F.least("cls", "h.cls").alias("a"), F.greatest("cls", "h.cls").alias("b")).distinct()


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that agree on at least MATCHES coordinates."""
    left, right = reps.select(F.col("cls").alias("a"), F.col("sig").alias("x")), reps.select(F.col("cls").alias("b"), F.col("sig").alias("y"))
    same = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, e: s + e)
    return pairs.join(left, "a").join(right, "b").where(same >= MATCHES).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _blocked(rows: DataFrame, group: str, width: int, bytes_each: Column, scratch: Scratch) -> DataFrame:
    """``rows`` (group, label, ...) dealt into blocks: those outside the group's largest label ask all.

    Adds g, i, j, asks: within (g, i, j) and the group, each asking row meets each asked
    row; blocks hold about ``width`` rows and BLOCK_BYTES a side. Groups of one block share
    a g by thousands of rows, so that tasks do not start a call for every pair of rows.
    """
    rows = rows.withColumn("bytes", bytes_each)
    counts = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    sizes = counts.groupBy(group).agg(F.sum("c").alias("size"), F.sum("bytes").alias("bytes"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = F.greatest(F.ceil(F.col("size") / width), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = scratch.table(sizes.select(group, blocks.alias("blocks"), F.col("top.label").alias("top"), "size", F.col("bytes").alias("all")))
    total, weight = sizes.agg(F.sum("size"), F.sum("all")).first()
    packs = max(1, (total or 0) // (4 * width), (weight or 0) // BLOCK_BYTES)
    rows = rows.drop("bytes").join(sizes.drop("size", "all"), group).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    packed = F.pmod(F.xxhash64(group), F.lit(packs))
    rows = rows.withColumn("g", F.when(F.col("blocks") == 1, packed).otherwise(F.col(group)))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = rows.where("label <> top").select("*", F.lit(True).alias("asks"), F.col("block").alias("i"), every.alias("j"))
    asked = rows.select("*", F.lit(False).alias("asks"), F.col("block").alias("j"), every.alias("i"))
    return asking.unionByName(asked).drop("block", "top")


def _joining(near, left: pd.DataFrame, right: pd.DataFrame) -> list[tuple[int, int]]:
    """Pairs (a, b) that join labels: a spanning forest of what ``near(i)``, a mask of right, says."""
    root, rc, found = right["label"].to_numpy().copy(), right["cls"].to_numpy(), []
    own = {label: label for label in set(root) | set(left["label"])}
    for i, (a, label) in enumerate(zip(left["cls"], left["label"], strict=True)):
        mask = near(i)
        while len(apart := np.flatnonzero(mask & (root != own[label]))):
            b = apart[0]
            found.append((a, rc[b]))
            old, new = root[b], own[label]
            root[root == old] = new
            for k, v in own.items():
                if v == old:
                    own[k] = new
    return found


def loose_pairs(posts: DataFrame, labels: DataFrame, reps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different components that agree on enough coordinates.

    Only lists with several components take part, and of the pairs that agree in a list as
    many come back as join its components: what they join holds every pair that agrees.
    """
    labelled = posts.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    both = _blocked(labelled.select("key", "cls", "label", "n"), "key", BLOCK, F.lit(8 * K), scratch).join(reps.select("cls", "sig"), "cls")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in frame.groupby("key", sort=False):
            left, right = part[part["asks"]], part[~part["asks"]]
            if left.empty or right.empty:
                continue
            x, y = np.stack(left["sig"].to_numpy()), np.stack(right["sig"].to_numpy())
            ln, rn = left["n"].to_numpy(), right["n"].to_numpy()
            found += _joining(lambda i: (100 * np.minimum(rn, ln[i]) >= percent * np.maximum(rn, ln[i])) & ((y == x[i]).sum(axis=1) >= MATCHES), left, right)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return both.groupBy("g", "blocks", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def remaining_links(labels: DataFrame, loose: DataFrame, edges: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links, confirmed on full sets, that join the components of ``labels``.

    Clusters are what links and loose pairs join; a missing link lies within a cluster.
    Every class outside the largest component of its cluster meets all of the cluster.
    """
    clusters = connected_components(edges.union(loose), scratch).select(F.col("node").alias("cls"), F.col("label").alias("cluster"))
    rows = clusters.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    both = _blocked(rows.join(reps.select("cls", "n"), "cls"), "cluster", SET_BLOCK, 8 * F.col("n"), scratch).drop("n").join(sets, "cls")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in frame.groupby("cluster", sort=False):
            left, right = part[part["asks"]], part[~part["asks"]]
            if left.empty or right.empty:
                continue
            x = [np.frombuffer(v, np.uint64) for v in left["shingles"]]
            y = [np.frombuffer(v, np.uint64) for v in right["shingles"]]
            rn = np.array([len(v) for v in y])
            starts = np.concatenate([[0], np.cumsum(rn)[:-1]])
            vocabulary, at = np.unique(np.concatenate(y), return_inverse=True)

            def near(i: int, x=x, rn=rn, starts=starts, vocabulary=vocabulary, at=at) -> np.ndarray:
                place = np.minimum(np.searchsorted(vocabulary, x[i]), len(vocabulary) - 1)
                has = np.zeros(len(vocabulary), np.int64)
                has[place[vocabulary[place] == x[i]]] = 1
                both = np.add.reduceat(has[at], starts)
                return 100 * both >= percent * (rn + len(x[i]) - both)

            found += _joining(near, left, right)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return both.groupBy("g", "blocks", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Rows are linked if 100 * intersection >= percent * union of their distinct
    ``width``-word shingles (words lower-cased in A-Z only, split on ASCII white space).
    component_id is the least doc_id reachable over links; kept marks doc_id = component_id
    (null-safe). A shorter text is one shingle of all its words. Null texts and texts
    without words have no shingles and no links. Repeated rows are linked like any equal
    texts. Other columns of ``docs`` are not read.
    """
    return _near_duplicates(docs, doc_id, text, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """The same with th and first: whether (doc_id, th) names the row that stands for its component.

    That row is of least doc_id, then least th, with null ids last; rows of equal doc_id and
    text share it. It is true for rows without shingles.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _components(docs, doc_id, text, width, percent, scratch)


def candidate_texts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(cls, hi, lo, text): the rows of ``docs`` that have the id and the text of a wanted class.

    wanted(cls, id, th, hi, lo) has one row for each pair of id and text, so each row of
    ``docs`` comes at most once, however many rows share an id or have none.
    """
    texts = docs.select(F.col(doc_id).alias("own"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).where("text IS NOT NULL")
    same = (F.col("hash") == F.col("th")) & F.col("own").eqNullSafe(F.col("id"))
    return texts.join(wanted, same).select("cls", "hi", "lo", "text")


def _components(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, scratch: Scratch) -> DataFrame:
    rows = scratch.table(sketch(docs, doc_id, text, width).withColumn("rid", F.monotonically_increasing_id()), keep=True)
    filled = rows.where("n_shingles > 0")
    # Of a component the row of least doc_id stands for all; where ids are null, the least hash does.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = scratch.table(filled.groupBy("hi", "lo").agg(F.min("rid").alias("cls"), F.min(order).alias("least")))
    reps = filled.join(classes.select(F.col("cls").alias("rid")), "rid").select(F.col("rid").alias("cls"), "doc_id", "th", "hi", "lo", F.col("n_shingles").alias("n"), "sig")
    reps = scratch.table(reps)
    posts = scratch.table(posting_lists(reps))

    # The full sets of the classes that have a candidate at all, cut from the texts again.
    wanted = reps.join(posts.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("doc_id").alias("id"), "th", "hi", "lo")

    def make():
        def apply(texts):
            sets = [shingles(t, width) for t in texts]
            digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
            return [d[0] for d in digests], [d[1] for d in digests], [s.tobytes() for s in sets]

        return apply

    sets = add_text_columns(candidate_texts(docs, doc_id, text, wanted), "text", make, "hi2 bigint, lo2 bigint, shingles binary").where("hi = hi2 AND lo = lo2")
    sets = scratch.table(sets.select("cls", "shingles").dropDuplicates(["cls"]))

    edges = scratch.table(confirmed(agreeing(hub_pairs(posts, percent), reps), sets, percent))
    labels = connected_components(edges, scratch)
    loose = scratch.table(loose_pairs(posts, labels, reps, percent, scratch))
    more = scratch.table(remaining_links(labels, loose, edges, reps, sets, percent, scratch))
    labels = connected_components(edges.union(more), scratch)

    # Few classes have a link; those of one component are dealt to parts, however many they are.
    member = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).alias("part")
    linked = classes.join(labels.select(F.col("node").alias("cls"), "label"), "cls")
    best = linked.groupBy("label").agg(F.min("least").alias("best")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    linked = linked.select("hi", "lo", "label", member).join(best, ["label", "part"]).select("hi", "lo", "best")
    alone = classes.join(labels.select(F.col("node").alias("cls")), "cls", "left_anti").select("hi", "lo", F.col("least").alias("best"))
    named = scratch.table(linked.unionByName(alone).select("hi", "lo", "best"), keep=True)
    out = rows.select("doc_id", "th", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    filled = F.col("n_shingles") > 0
    component = F.when(filled, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    first = ~filled | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    out = out.select("doc_id", "th", "n_shingles", component.alias("component_id"), first.alias("first"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's sets: four-word shingles, similarity 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one of least doc_id.

    Rows go, not ids: an id with several texts keeps each text that nothing earlier is like,
    and of repeated rows one stays. Among equal ids the least hash of the text decides, and
    null ids come last. Null texts and texts without words are like nothing: all stay.
    """
    found = _near_duplicates(docs, "doc_id", "text", 5, 80)
    key = F.struct("doc_id", "th")
    drop = found.where(~F.col("first")).select(key.alias("gone")).distinct()
    mine = F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("th"))
    kept = docs.join(drop, mine.eqNullSafe(drop["gone"]), "left_anti")
    # Rows that repeat an id and a text stay once; as a rule there are none, and no text is shuffled.
    twice = found.where("first AND n_shingles > 0").groupBy("doc_id", "th").count().where("count > 1").select(key.alias("twice"))
    if twice.isEmpty():
        return kept
    mine = F.struct(kept["doc_id"].alias("doc_id"), F.xxhash64(kept["text"]).alias("th"))
    once = kept.join(twice, mine.eqNullSafe(twice["twice"]), "left_anti")
    repeated = kept.join(twice, mine.eqNullSafe(twice["twice"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)
