"""Operator 2: a classifier on learned subword vectors.

Each word, each of its character n-grams and each pair of neighbouring words is
hashed to a row of a table of learned vectors; a document is the average of all
of these rows, and a softmax layer on it gives the probability of each label.
Table and layer are trained by stochastic gradient descent in numpy on the driver, on at
most `max_train_docs` labelled documents and `max_train_bytes` of their text
(those with the least hashes of their doc_id; whole texts). Because the layer is
linear, what a row adds to the difference of the two outputs is one number, so
scoring needs a lookup a word and one a pair.

Pairs of words go beyond plain subword vectors, and their hash is chosen: it is
taken of the difference of the words' hashes, so a word that follows itself has
the same row whatever the word. What that row weighs is learned, but that it
exists is by design, as a feature for repeated words would be: with pairs hashed
by both words in order, most junk made of repeats unseen in training is missed
(figures in README).

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2;
the others are held out. Texts without words get the share of label 1 among
the training rows. Null texts count as empty; repeated rows are scored each on
its own, and of rows that repeat a doc_id the least text is learned from; a
doc_id with several labels has the least. An empty table gives an empty result;
other columns of the input are ignored. Without labelled rows every score is
0.5; with labels of one kind only, it is that kind's.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, picked, slices, table
from .kmers import mix

BUCKETS, DIMENSIONS, SHORTEST, LONGEST = 1 << 17, 12, 3, 4
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES, EPOCHS, RATE, SEED, THRESHOLD = 4000, 64 << 20, 6, 0.5, 7, 0.7
HELD_OUT = 2


def subwords(word: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Rows of the table for a word and its n-grams of characters, with marks at its ends."""
    marked = "<" + word.decode("utf-8", "replace") + ">"
    grams = [word, *(marked[k : k + n].encode() for n in range(SHORTEST, LONGEST + 1) for k in range(len(marked) - n + 1))]
    return np.fromiter(map(xxhash.xxh32_intdigest, grams), np.int64, len(grams)) % buckets


def pairs(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Rows of the table for neighbouring words; one row for all words that follow themselves."""
    with np.errstate(over="ignore"):
        return (mix(hashes[1:] - hashes[:-1] + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def is_held_out(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary")) % 4 == HELD_OUT


class Words(dict):
    """Numbers of words, and for each word its hash, the sum of its subwords' weights and how many there are."""

    #: Words that are remembered between batches.
    MOST = 400_000

    def __init__(self, weights: np.ndarray):
        self.weights, self.sums, self.counts, self.hashes = weights, array("d"), array("q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        rows = subwords(word, len(self.weights))
        self.sums.append(float(self.weights[rows].sum()))
        self.counts.append(len(rows))
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self[word] = len(self.sums) - 1
        return len(self.sums) - 1


class Model:
    """weights: of each row of the table, its part in output 1 minus output 0; bias likewise."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior
        self.words = Words(weights)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > Words.MOST:
            self.words = Words(self.weights)
        known = self.words
        lists = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        number = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, sizes.sum())
        sums, counts, hashes = np.array(known.sums, np.float64)[number], np.array(known.counts, np.int64)[number], np.array(known.hashes, np.uint64)[number]
        doc = np.repeat(np.arange(len(lists)), sizes)
        total, n = np.bincount(doc, sums, len(lists)), np.bincount(doc, counts, len(lists))
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        total += np.bincount(doc[inner], self.weights[pairs(hashes, len(self.weights))[inner]] if len(inner) else None, len(lists))
        n += np.bincount(doc[inner], minlength=len(lists))
        logit = total / np.maximum(n, 1) + self.bias
        return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(logit, -500, 500))), self.prior)


def train(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent, a document a step, with a rate that falls to nothing."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(buckets), float(np.log(share / (1 - share))), share)
    rng, memo, docs = np.random.default_rng(seed), {}, []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        for word in words:
            if word not in memo:
                memo[word] = subwords(word, buckets), xxhash.xxh64_intdigest(word)
        if words:
            every = np.concatenate([*(memo[w][0] for w in words), pairs(np.array([memo[w][1] for w in words], np.uint64), buckets)])
            ids, count = np.unique(every, return_counts=True)
            docs.append((ids.astype(np.uint32), (count / count.sum()).astype(np.float32)))
        else:
            docs.append((np.zeros(0, np.uint32), np.zeros(0, np.float32)))
    memo.clear()
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    layer, bias = np.zeros((dimensions, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 / share  # both labels weigh alike; undone in the bias below
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            ids, part = docs[d]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            hidden = part @ vectors[ids]
            out = hidden @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[labels[d]] -= 1
            p *= weight[labels[d]]
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * p
            # A row's part in an average over hundreds is small; scaled up, the table learns as fast as the layer.
            vectors[ids] -= (lr * min(50.0, 0.5 / float(part.max()))) * np.outer(part, back)
    odds = float(np.log(share[1] / share[0]))
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]) + odds, float(share[1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES) -> Model:
    marked = picked(labels, "doc_id", label).toDF("doc_id", "label")
    known = marked.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    rows = doc_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # max_train_docs rows at most
    size = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    learned = rows.withColumn("upto", size).where(F.col("upto") <= max_train_bytes).orderBy("doc_id").select("text", "label").toPandas()
    return train(learned["text"].tolist(), learned["label"].to_numpy(dtype=np.int64))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior))
    kept: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Model(*sent.value))
        for batch in slices(batches, "text"):
            score = kept[0].scores(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = doc_text(docs).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
