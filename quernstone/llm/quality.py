"""Quality classifier with supervised subword embeddings.

Every word, pair of neighbouring words and byte n-gram of a text has a hashed vector; a text is the mean of its vectors,
and a softmax over a linear layer gives the classes. Vectors and layer are learned together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. Since the layer is linear, each vector's share of the two class
scores can be computed once for the whole table, so scoring a text is a mean of two numbers for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, slices
from .features import Bytes, grams, held_out, mixed, training_rows

BUCKETS, DIM, SIZES = 1 << 17, 8, (3, 4)
EPOCHS, RATE, BATCH = 5, 0.3, 16
THRESHOLD = 0.3
PRIOR_WEIGHT = 1.0

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, texts in order, and the number of features of each text."""
    source = Bytes(texts)
    starts, ends, doc = source.words(_SPACES)
    words = source.hashes(starts, ends)
    pair = np.empty_like(words)
    if len(words):
        with np.errstate(over="ignore"):
            pair[1:] = mixed(words[:-1] * np.uint64(3) + words[1:])
        pair[1:][words[1:] == words[:-1]] = _REPEAT  # a word said twice running is one feature, whatever the word
        pair[0] = 0
        pair[1:][doc[1:] != doc[:-1]] = 0
    sub, counts = grams(source, starts, ends, SIZES)
    per_word = counts + 2
    flat = np.empty(int(per_word.sum()), np.uint64)
    begin = np.cumsum(per_word) - per_word
    flat[begin] = words
    flat[begin + 1] = pair
    flat[np.repeat(begin + 2, counts) + np.arange(len(sub)) - np.repeat(np.cumsum(counts) - counts, counts)] = sub
    per_doc = np.bincount(doc, weights=per_word, minlength=len(texts)).astype(np.int64)
    return (flat % np.uint64(BUCKETS)).astype(np.int32), np.repeat(np.arange(len(texts)), per_doc), per_doc


class Model:
    """Class-score shares of every bucket, and the bias; probability of class 1 for a text."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        shares = vectors @ layer
        self.margin = (shares[:, 1] - shares[:, 0]).astype(np.float64)
        self.bias = float(bias[1] - bias[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        bucket, doc, per_doc = features(texts)
        total = np.bincount(doc, weights=self.margin[bucket], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(per_doc, 1) + self.bias, -30, 30)))


def fit(rows: list[tuple[bytes, int]], seed: int = 1) -> Model:
    """Stochastic gradient descent over whole texts, in a seeded order, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    labels = np.array([y for _, y in rows], np.int64)
    if not len(labels):
        return Model(vectors * 0, layer, bias)
    parts = []
    for text, _ in rows:  # each text once as distinct buckets with their weights in the mean
        bucket, count = np.unique(features([text])[0], return_counts=True)
        parts.append((bucket, count / max(1, count.sum())))
    bias[:] = np.log(np.bincount(labels, minlength=2) + PRIOR_WEIGHT)
    bias -= bias.mean()
    steps, done = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            docs = order[at : at + BATCH]
            bucket = np.concatenate([parts[d][0] for d in docs])
            weight = np.concatenate([parts[d][1] for d in docs])
            row = np.repeat(np.arange(len(docs)), [len(parts[d][0]) for d in docs])
            gathered = vectors[bucket] * weight[:, None]
            mean = np.stack([np.bincount(row, gathered[:, k], len(docs)) for k in range(DIM)], 1)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            to_mean = p @ layer.T
            layer -= rate * mean.T @ p
            bias -= 0.1 * rate * p.sum(0)
            # weights of a mean are small: vectors get steps on the scale of the number of distinct features
            scale = np.array([len(parts[d][0]) for d in docs])[row]
            np.add.at(vectors, bucket, (-rate * scale * weight)[:, None] * to_mean[row] * 0.5)
    return Model(vectors, layer, bias)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text"):
            scores = model.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (probability of quality 1) and predicted (score >= 0.3) for every row of docs.

    Defined cases: null and empty texts have no features and score by the learned prior; one row for each input row,
    repeated rows alike; a null doc_id scores too and its held_out is null; without usable labels every score is 0.5.
    Only texts are read to score; other columns of docs never count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, "quality")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_arrow(docs.select("doc_id", "text"), _score(shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
