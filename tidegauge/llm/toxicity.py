"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, their stems (the first four and five bytes, for
languages that inflect), word pairs and pairs with one word between (lower case, without
punctuation), each counted once. Every coordinate has its own learning
rate and an L1 penalty keeps most weights at exactly zero; what is shipped to the executors
is the sparse list of the others.

Defined results: a null or empty text scores the bias alone; without labels every score is
that of a margin of -30, below 1e-13; repeated rows score alike, and an id of several texts is
learnt from once; an empty table gives an empty table; extra columns are ignored, whatever their
names. Whole texts are scored where they are, and only the training sample is shuffled.

The sample is bounded twice: at most ``MOST_ROWS`` documents, of which those are taken, in the order
of a hash of their ids, that together have at most ``MOST_FEATURES`` features (four bytes each on
the driver). A document with more features than that is scored but not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textbatch import IS_BREAK, LOWER, mix, runs, slices, word_hashes
from .training import held_out, labelled

#: At most so many labelled rows are learnt from, with at most so many features in all, in so many passes.
MOST_ROWS, MOST_FEATURES, PASSES = 12_000, 16 << 20, 4
BITS = 20
STEMS = (4, 5)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 0.1
THRESHOLD = 0.3


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed feature) of every occurrence, unsorted."""
    starts, ends, at = runs(~IS_BREAK[buf], off)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at))
    h = word_hashes(LOWER[buf], starts, ends)
    owners, found = [owner], [h]
    for letters in STEMS:
        longer = ends - starts > letters
        stem = word_hashes(LOWER[buf], starts[longer], starts[longer] + letters)
        owners.append(owner[longer])
        found.append(mix(stem + np.uint64(letters)))
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = owner[gap:] == owner[:-gap]
        owners.append(owner[gap:][same])
        found.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Weights:
    """The bias and the weights that aren't zero."""

    bias: float
    places: np.ndarray
    values: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.places] = self.values
        return out

    def score(self, buf: np.ndarray, off: np.ndarray, dense: np.ndarray) -> np.ndarray:
        owner, found = features(buf, off)
        heavy = dense[found] != 0
        pairs = np.unique(owner[heavy] << BITS | found[heavy])
        margin = self.bias + np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, passes: int = PASSES, seed: int = 7) -> Weights:
    """Learns online from rows of distinct features; the bias has no L1 penalty."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z, bias_n, rng = 0.0, 0.0, np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        own = z[i]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    bias = lambda: -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w, b = weights(i), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y[k]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    if not len(rows):
        return Weights(-30.0, np.zeros(0, np.int64), np.zeros(0))
    places = np.flatnonzero(np.abs(z) > L1)
    return Weights(float(bias()), places, weights(places))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", most_features: int = MOST_FEATURES) -> Weights:
    """Fits the model on at most ``most`` labelled rows, of whose features at most ``most_features`` come to the driver, as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, off in slices(b.column(1)):
                owner, found = features(buf, off)
                pairs = np.unique(owner << BITS | found)
                cut = np.searchsorted(pairs >> BITS, np.arange(len(off)))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs & ((1 << BITS) - 1), pa.int32()))
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), lists], names=["id", "label", "x"])

    sample = written(labelled(docs, labels, "toxic", most, id_col, text_col).mapInArrow(run, "id long, label int, x array<int>"), "features")
    sizes = sample.select("id", F.xxhash64("id").alias("h"), F.size("x").alias("n")).toArrow().sort_by("h")  # ``most`` rows of three numbers
    n = sizes.column("n").to_numpy()
    if n.sum() > most_features:
        taken, room = [], most_features
        for i, k in zip(sizes.column("id").to_pylist(), n.tolist(), strict=True):
            if k <= room:
                taken.append(i)
                room -= k
            elif k <= most_features:
                break
        sample = sample.join(F.broadcast(sample.sparkSession.createDataFrame(pa.table({"id": pa.array(taken, pa.int64())}))), "id", "left_semi")
    got = sample.toArrow().sort_by("id")
    rows = [np.asarray(x.values) for x in got.column("x")]
    return fit(rows, got.column("label").to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, most, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for b in batches:
            for first, last, buf, off in slices(b.column(1)):
                ids = b.column(0).slice(first, last - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(buf, off, dense), pa.float64())], names=["doc_id", "score"])

    got = docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
