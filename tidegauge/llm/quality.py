"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are computed with numpy over its bytes. Values are binned by the
training sample's quantiles; trees grow level by level from gradient histograms under the
logistic loss, and are flattened into arrays of equal shape, so that scoring walks all rows
through all trees at once.

Defined results: null and empty texts have statistics of zeros and a score like any other
text; without labels of both kinds every score is the labels' mean, kept a millionth away from 0
and 1 (0.999999 without labels). Rows are scored where they are, and only the training sample is
shuffled; repeated rows score alike, and an id of several texts is learnt from once; an empty
table gives an empty table; extra columns are ignored, whatever their names; texts of any length
are worked off in bounded slices, a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import IS_SPACE, LOWER, code_points, runs, slices, word_hashes
from .training import held_out, labelled

#: At most so many labelled rows are learnt from.
MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 80, 4, 64, 0.12, 2.0, 3.0
THRESHOLD = 0.7

CLASSES = {
    "digit": [*range(0x30, 0x3A)],
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "stop": [ord(c) for c in ".,;:?"],
    "bang": [ord("!")],
    "symbol": [ord(c) for c in "#$%&*@^~`=+<>{}[]_\\/"],
    "bar": [ord("|")],
    "quote": [ord(c) for c in "\"'()-"],
    "long": [*range(0x80, 0x100)],
}
NAMES = [
    "log_bytes", "log_words", "space", *CLASSES, "word_len", "word_sd", "short_words", "long_words", "longest_word",
    "distinct_words", "top_word", "log_lines", "line_len", "line_sd", "distinct_lines", "stop_per_word", "capital_words", "upper_of_letters", "repeated_pairs",
]


def sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(mask) + 1, dtype=np.float64)
    np.cumsum(mask, out=upto[1:])
    return upto[off[1:]] - upto[off[:-1]]


def repeats(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner the number of distinct hashes, and the most frequent one's count."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    first = np.ones(len(o), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[at], counts)
    return np.bincount(o[at], minlength=n).astype(float), top


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each text."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    some = np.maximum(size, 1)
    cols: dict[str, np.ndarray] = {"log_bytes": np.log1p(code_points(buf, off)), "space": sums(IS_SPACE[buf], off) / some}
    for name, members in CLASSES.items():
        table = np.zeros(256, dtype=bool)
        table[members] = True
        cols[name] = sums(table[buf], off) / some
    starts, ends, at = runs(~IS_SPACE[buf], off)
    count = np.diff(at).astype(float)
    words, owner, lens = np.maximum(count, 1), np.repeat(np.arange(n), np.diff(at)), (ends - starts).astype(float)
    mean = lambda x: np.bincount(owner, weights=x, minlength=n) / words
    cols["log_words"], cols["word_len"] = np.log1p(count), mean(lens)
    cols["word_sd"] = np.sqrt(np.maximum(mean(lens**2) - cols["word_len"] ** 2, 0))
    cols["short_words"], cols["long_words"] = mean(lens <= 3), mean(lens > 12)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, lens)
    cols["longest_word"] = np.log1p(longest)
    h = word_hashes(LOWER[buf], starts, ends)
    distinct, top = repeats(owner, h, n)
    cols["distinct_words"], cols["top_word"] = distinct / words, top / words
    same = owner[1:] == owner[:-1]
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
    distinct, _ = repeats(owner[:-1][same], pairs, n)
    cols["repeated_pairs"] = 1 - distinct / np.maximum(count - 1, 1)
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    cols["stop_per_word"] = mean(np.isin(last, [ord(c) for c in ".!?"]))
    head = buf[starts] if len(starts) else np.zeros(0, np.uint8)
    cols["capital_words"] = mean((head >= 0x41) & (head <= 0x5A))
    cols["upper_of_letters"] = cols["upper"] / np.maximum(cols["upper"] + cols["lower"], 1e-9)
    starts, ends, at = runs(buf != 0x0A, off)
    count = np.diff(at).astype(float)
    lines, owner, lens = np.maximum(count, 1), np.repeat(np.arange(n), np.diff(at)), (ends - starts).astype(float)
    mean = lambda x: np.bincount(owner, weights=x, minlength=n) / lines
    cols["log_lines"], cols["line_len"] = np.log1p(count), np.log1p(mean(lens))
    cols["line_sd"] = np.log1p(np.sqrt(np.maximum(mean(lens**2) - mean(lens) ** 2, 0)))
    distinct, _ = repeats(owner, word_hashes(buf, starts, ends), n)
    cols["distinct_lines"] = distinct / lines
    return np.stack([cols[k] for k in NAMES], axis=1)


@dataclass
class Forest:
    """Trees of one depth as arrays: inner nodes' features and thresholds, and the leaves' values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        margin = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            depth = int(np.log2(self.leaf.shape[1]))
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            margin += self.leaf[trees, node - (2**depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosts ``trees`` trees; splits maximise the gain of second-order logistic loss."""
    mean = y.mean() if len(y) else 1.0
    base = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(np.unique(y)) < 2:
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(f)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k]) for k in range(f)], axis=1)
    margin = np.full(n, base)
    out_f, out_t, out_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    flat = binned + np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cell = ((node - first)[:, None] * (f * bins) + flat).ravel()
            hist_g = np.bincount(cell, weights=np.repeat(g, f), minlength=width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            hist_h = np.bincount(cell, weights=np.repeat(h, f), minlength=width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            all_g, all_h = hist_g[:, :1, -1:], hist_h[:, :1, -1:]
            right_g, right_h = all_g - hist_g, all_h - hist_h
            gain = hist_g**2 / (hist_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            gain[(hist_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    out_f[t, first + k], out_t[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), out_f[t, node]] > out_t[t, node])
        leaf = node - inner
        out_l[t] = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + L2)
        margin += out_l[t][leaf]
    return Forest(base, out_f, out_t, out_l)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fits the classifier; the driver receives ``most`` rows of statistics at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, off in slices(b.column(1)):
                part = b.slice(first, last - first)
                x = statistics(buf, off)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "x"])

    got = labelled(docs, labels, "quality", most, id_col, text_col).mapInArrow(run, "id long, label int, x array<double>").toArrow().sort_by("id")
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
    return fit(x, got.column("label").to_numpy().astype(float))


def scored(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, off in slices(b.column(1)):
                ids = b.column(0).slice(first, last - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(forest.score(statistics(buf, off)), pa.float64())], names=["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    got = scored(docs, train(docs, labels, most))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, in one pass over the texts."""
    forest, kept, at = train(docs, labels), docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, off in slices(b.column(at)):
                yield b.slice(first, last - first).filter(pa.array(forest.score(statistics(buf, off)) >= threshold))

    return docs.mapInArrow(run, kept)
