"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A word gives two tokens: itself, in lower case, and its shape (runs of upper-case, lower-
case and other letters, digits, and its signs as they are). N-grams are single words and
sequences of up to three shapes; a shape is marked where its word pair has come before in
the text, so that repetition is seen. Each n-gram is hashed to one of 2**18 weights; its
value is 1 + log(count), the vector has length 1, and the score is the logistic function
of the sparse dot product.

The model is fitted on at most ``PER_CLASS`` labelled rows of each class (the smallest
hashes of the id). Their sparse vectors are made in parallel and meet in one task, which
runs the updates in a fixed order; one pass takes a fraction of a second.

Defined results: a null or empty text is scored by the intercept alone. Without training
rows of both classes all scores are 0.5. Rows without an id are scored, not held out.
Columns other than the id and the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

BITS = 18
BUCKETS = 1 << BITS
PER_CLASS = 3000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
CACHED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_shape(word: str) -> str:
    """Runs of letters as X, x or o (upper, lower, other), digits as 9, signs as they are."""
    out, last = [], ""
    for character in word:
        if character.isalpha():
            kind = "X" if character.isupper() else "x" if character.islower() else "o"
        else:
            kind = "9" if character.isdigit() else character
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


class Features:
    """Sparse vectors of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _hashes(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(word_shape(word), 1)
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        both = np.array([self._hashes(word) for word in words], np.uint64)
        lexical, shape = both[:, 0], both[:, 1].copy()
        pairs = lexical[:-1] * _MIX + lexical[1:]
        seen = np.ones(len(pairs), bool)
        seen[np.unique(pairs, return_index=True)[1]] = False
        shape[1:][seen] ^= np.uint64(0x5BF03635)
        grams = [lexical, shape * _MIX + np.uint64(1)]
        for length in (2, 3):
            if len(words) >= length:
                gram = shape[: len(shape) - length + 1].copy()
                for k in range(1, length):
                    gram = (gram ^ (gram >> np.uint64(29))) * _MIX + shape[k : len(shape) - length + 1 + k]
                grams.append(gram * _MIX + np.uint64(length))
        codes = np.concatenate(grams)
        codes ^= codes >> np.uint64(32)
        codes *= _MIX
        buckets, counts = np.unique((codes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        values = 1 + np.log(counts)
        return buckets, (values / np.linalg.norm(values)).astype(np.float32)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS
) -> np.ndarray:
    """Weights after the regularised-leader updates; the last one is the intercept."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights_at(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for buckets, values, label in rows:
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights_at(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - step * w
            n[at] += gradient**2
    return weights_at(np.arange(BUCKETS + 1)).astype(np.float32)


def fit(sample: DataFrame) -> np.ndarray:
    """The weights from a bounded sample (doc_id, text, label)."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            made = [features(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("label").cast(pa.int32()),
                    pa.array([buckets for buckets, _ in made], pa.list_(pa.int64())),
                    pa.array([values for _, values in made], pa.list_(pa.float32())),
                ],
                ["doc_id", "label", "buckets", "values"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (row, buckets.values.to_numpy(), values.values.to_numpy(), label)
            for batch in batches
            for row, label, buckets, values in zip(
                batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(),
                batch.column("buckets"), batch.column("values"),
            )
        ]
        rows.sort(key=lambda row: xxhash.xxh64_intdigest(str(row[0])))
        if len({row[3] for row in rows}) < 2:
            return
        weights = follow_the_leader([row[1:] for row in rows])
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used])], ["bucket", "weight"])

    made = sample.mapInArrow(vectors, "doc_id long, label int, buckets array<long>, values array<float>")
    # The sample is bounded: one task may hold it.
    learnt = made.repartition(1).mapInArrow(train, "bucket long, weight float").toPandas()
    weights = np.zeros(BUCKETS + 1, np.float32)
    weights[learnt["bucket"].to_numpy(int)] = learnt["weight"]
    return weights


def scorer(documents: DataFrame, weights: np.ndarray):
    """A column function: text to the probability of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, learnt = Features(), shared.value
        for texts in batches:
            scores = []
            for text in texts:
                buckets, values = features(text)
                scores.append(float(learnt[buckets] @ values + learnt[BUCKETS]))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(scores, float), -30, 30))))

    return probability


def score(documents: DataFrame, weights: np.ndarray, threshold: float, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    probability = scorer(documents, weights)
    scored = documents.select("doc_id", "text").select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        probability("text").alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
