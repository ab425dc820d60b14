"""A quality classifier with supervised subword embeddings.

Words and their character n-grams are hashed to rows of an embedding table; a document is the mean of its rows (with SMOOTHING empty rows added, so
that a few words say little), and a softmax layer over it gives the label. Table and layer are
learned together by stochastic gradient descent in numpy on a bounded sample of labelled
rows. As the layer is linear, scoring needs only one number for each table row, so whole
texts are scored from one number for each distinct word.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import add_text_columns, fresh, held_out, read

BUCKETS = 1 << 17
DIM = 16
NGRAMS = (3, 4)
SMOOTHING = 100
EPOCHS = 4
RATE = 0.5
#: Labelled rows learned from, the least by hash of the id, and the longest text among them:
#: these bound what the driver holds.
MOST_LABELLED = 4000
LONGEST_LABELLED = 50_000
THRESHOLD = 0.3


def _row(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def features(word: str) -> list[int]:
    """Table rows of a word: its own and those of the n-grams of ``<word>``."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return list(map(_row, grams))


def bag(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text and their shares of all its rows."""
    words = text.split()
    rows: list[int] = []
    for w in words:
        if w not in known:
            known[w] = features(w)
        rows += known[w]
    if not rows:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    found, times = np.unique(np.array(rows, np.int32), return_counts=True)
    return found, (times / (len(rows) + SMOOTHING)).astype(np.float32)


class Model:
    """Weight of each table row and the bias, as log odds of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def train(texts: list[str], labels: list[int], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Learn table and layer; without rows of both labels the prior alone remains."""
    prior = (sum(labels) + 1) / (len(labels) + 2)
    start = float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), start)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.array([0.0, start], np.float32)
    known: dict[str, list[int]] = {}
    bags = [bag(t, known) for t in texts]
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            rows, share = bags[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            mean = share @ table[rows] if len(rows) else np.zeros(DIM, np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * np.float32(0.1) * p
            if len(rows):
                # A mean passes little to each row; scaling by their number keeps rows learning.
                table[rows] -= (step * share * len(rows))[:, None] * back
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, learn: Column, *, most: int = MOST_LABELLED, longest: int = LONGEST_LABELLED) -> Model:
    """Learn from at most ``most`` labelled rows for which ``learn`` holds.

    Rows are the least by hash of the id. Labels other than 0 and 1, null ids and texts of
    null or beyond ``longest`` characters are not learned from; an id with several texts or
    labels counts for each of them, repeats of the same count once.
    """
    given = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).distinct()
    texts = docs.where(learn & (F.length(text) <= longest)).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # The join is on narrow rows first: only the chosen pairs of id and text bring their text.
    pairs = texts.select("id", F.xxhash64("text").alias("h")).join(given, "id").distinct()
    chosen = pairs.orderBy(F.xxhash64("id"), "id", "h", "label").limit(most).collect()
    if not chosen:
        return train([], [])
    kind = docs.schema[doc_id].dataType.simpleString()
    small = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in chosen], f"id {kind}, h long, label int"))  # at most ``most`` rows
    rows = texts.withColumn("h", F.xxhash64("text")).join(small, ["id", "h"]).dropDuplicates(["id", "h", "label"])
    found = sorted(rows.collect(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r["id"])), r["text"], r["label"]))
    return train([r["text"] for r in found], [r["label"] for r in found])


class Scorer:
    """Scores texts from one sum and one count for each word, kept for the words seen lately."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.sums, self.sizes = np.empty(0), np.empty(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        if len(self.place) > 400_000:
            self.place, self.sums, self.sizes = {}, np.empty(0), np.empty(0)
        new = list({w for words in split for w in words if w not in self.place})
        rows = [features(w) for w in new]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        if len(new):
            flat = self.model.weights[np.concatenate([np.array(r) for r in rows])].astype(float)
            self.place |= {w: i for i, w in enumerate(new, len(self.sums))}
            self.sums = np.concatenate([self.sums, np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]))])
            self.sizes = np.concatenate([self.sizes, sizes])
        out = np.full(len(texts), self.model.bias)
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                out[i] += self.sums[at].sum() / (self.sizes[at].sum() + SMOOTHING)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def score_quality(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), *, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns plus score (0 to 1, higher: label 1 likelier) and predicted, row by row.

    A null or empty text scores as the labels' prior. Texts are scored whole, a few hundred
    at a time. Repeated rows are each answered; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    (whole,) = fresh(keep, "text")
    rows = docs.select(*keep, F.col(text).alias(whole))

    def make():
        scorer = Scorer(Model(*shared.value))

        def apply(texts):
            found = [scorer.score(texts[i : i + 500]) for i in range(0, len(texts), 500)]
            s = np.concatenate(found) if found else np.empty(0)
            return s, (s >= threshold).astype(np.int32)

        return apply

    return add_text_columns(rows, whole, make, "score double, predicted int")


def op6_subword_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "quality", ~held_out(F.col("doc_id")))
    return score_quality(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, keep=("doc_id", "held_out"))
