"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 5).

Statistics are numpy counts over the bytes, words, windows and lines of whole texts. Trees are
fitted on the statistics of at most ``sample`` labelled rows (documented bound), binned by
quantiles, with second-order gains summed from histograms. A forest is three arrays, feature,
threshold and leaf, in heap order; scoring walks all trees of all rows of a batch at once.

Defined cases: a null or empty text has statistics of 0 and gets a score like any other; without
labels of both kinds the score is the share of the labels seen, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words as W
from fleetlens.llm.frames import named
from fleetlens.llm.labels import labelled_sample

SAMPLE = 20_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.2
L2 = 1.0
SYMBOLS, MARKS = b"#*$%&|<>", b"!?"


def _byte_class(b: int) -> int:
    if b == 10:
        return 1
    if b in W.SPACES:
        return 0
    if 97 <= b <= 122:
        return 2
    if 65 <= b <= 90:
        return 3
    if 48 <= b <= 57:
        return 4
    if b in SYMBOLS:
        return 5
    if b in MARKS:
        return 6
    return 8 if b >= 128 else 7


_CLASS = np.array([_byte_class(b) for b in range(256)])
_IS_LINE = W.table_of(lambda b: b != 10)
STATISTICS = [
    "words", "word_bytes", "lower", "upper", "digits", "symbols", "marks", "punctuation", "high", "distinct",
    "most_frequent", "repeated_next", "repeated_windows", "lines", "line_words", "repeated_lines",
]


def _distinct(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of different hashes, and the count of the most frequent one."""
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(first, len(key))))
    return np.bincount(owner, minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` per text."""
    parts = [np.empty((0, len(STATISTICS)))]
    for first, last, data, offsets in W.slices(column):
        n = last - first
        owner = np.repeat(np.arange(n), np.diff(offsets))
        classes = np.bincount(owner * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
        w = W.words(data, offsets)
        count = np.bincount(w.text, minlength=n)
        size = np.bincount(w.text, w.end - w.start, minlength=n)
        different, most = _distinct(w.text, w.hash, n)
        same = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
        next_same = np.bincount(w.text[1:][same], minlength=n)
        window_text, window = W.shingles(w, 3)
        windows = np.bincount(window_text, minlength=n)
        lines = W.words(data, offsets, table=_IS_LINE)
        n_lines = np.bincount(lines.text, minlength=n)
        per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
        parts.append(
            np.column_stack(
                [
                    np.log1p(count), size / per_word, *[classes[:, c] / per_byte for c in range(2, 9)], different / per_word,
                    most / per_word, next_same / per_word,
                    (windows - _distinct(window_text, window, n)[0]) / np.maximum(windows, 1),
                    np.log1p(n_lines), count / np.maximum(n_lines, 1),
                    (n_lines - _distinct(lines.text, lines.hash, n)[0]) / np.maximum(n_lines, 1),
                ]
            )
        )
    return np.concatenate(parts)


@dataclass
class Forest:
    """Trees of one depth in heap order; a node that does not split sends all rows to the left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        trees, inner = self.feature.shape
        tree, node = np.arange(trees), np.zeros((len(x), trees), np.int64)
        while trees and node.size and node.max() < inner:
            value = np.take_along_axis(x, self.feature[tree, node], axis=1)
            node = 2 * node + 1 + (value >= self.threshold[tree, node])
        margin = self.base + (self.leaf[tree, node - inner].sum(axis=1) if trees else np.zeros(len(x)))
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Forest:
    """Boost on the logistic loss. ``x`` is (rows, features), ``y`` 0 or 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, features = 2**depth - 1, x.shape[1]
    if not len(y) or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(features if trees else 0)]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            split = np.full(width, -1)
            at = np.zeros(width, np.int64)
            for j in range(features):
                key = (node - first) * bins + binned[j]
                sums = [np.bincount(key, v, width * bins).reshape(width, bins) for v in (g, h)]
                left_g, left_h = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
                all_g, all_h = (s.sum(axis=1, keepdims=True) for s in sums)
                gain = (
                    left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
                )[:, : len(edges[j])]
                if gain.shape[1]:
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best[better], split[better], at[better] = value[better], j, top[better]
            for k in np.flatnonzero(split >= 0):
                feature[t, first + k], threshold[t, first + k] = split[k], edges[split[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] >= threshold[t, node])
        place = node - inner
        sum_g, sum_h = np.bincount(place, g, inner + 1), np.bincount(place, h, inner + 1)
        leaf[t] = -rate * sum_g / (sum_h + l2)
        margin += leaf[t, place]
    return Forest(base, feature, threshold, leaf)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Forest:
    """A forest for ``labels.quality`` from at most ``sample`` labelled rows outside the held-out fold."""
    names = [f"s{i}" for i in range(len(STATISTICS))]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["label", *names])

    chosen = labelled_sample(docs, labels, "quality", sample, doc_id, text).select(F.col("label").cast("int"), "text")
    found = chosen.mapInArrow(rows, "label int, " + ", ".join(f"{n} double" for n in names)).toPandas()
    order = np.lexsort([found[n].to_numpy() for n in ["label", *names]])
    return fit(found[names].to_numpy(float)[order], found["label"].to_numpy(float)[order])


def score(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(forest.score(statistics(batch.column(1))), pa.float64())], ["doc_id", "score"]
            )

    return docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).mapInArrow(
        scores, f"doc_id {id_type}, score double"
    )
