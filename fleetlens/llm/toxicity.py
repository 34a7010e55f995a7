"""Toxicity by a counterfactual-regularised classifier (operator 10).

A logistic model over the presence of words and of word beginnings, chosen by their G2
association with the label among at most ``sample`` labelled rows (documented bound). In those
rows identity terms are swapped for others of their group, or left out, and the model pays for
every change this makes to the score. So a mention of a group neither raises nor lowers a
score by itself, which is what makes neutral mentions false positives.

Defined cases: a null or empty text has no features and scores the bias alone; without labels of
both kinds the score is the share of the labels seen, or 0.5. Texts of any length are read whole.
"""

from __future__ import annotations

import re
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
VOCABULARY = 4096
MIN_ROWS = 3
#: Least G2 of a feature; by chance one in about ten thousand reaches it.
MIN_G2 = 15.0
BEGINNINGS = (4, 5, 6)
STEPS = 300
RATE = 0.1
L2 = 1e-3
#: Weight of the squared score change under a swap.
FAIRNESS = 1.0
#: Terms of one group are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "female", "male", "nonbinary", "transgender"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual", "homosexual"),
    ("christian", "jewish", "muslim", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab", "indian", "chinese"),
    ("immigrant", "refugee", "native", "foreign"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
)
_TERM = W.table_of(lambda b: b >= 128 or chr(b).isalnum())


def text_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text number, feature) for slices of the column; a feature may repeat."""
    for first, _, data, offsets in W.slices(column):
        w = W.words(data, offsets, table=_TERM)
        owners, features = [w.text], [W.mix(w.hash)]
        size = w.end - w.start
        for k in BEGINNINGS:
            longer = size > k
            begin = W.spans(data, w.start[longer], w.start[longer] + k)
            owners.append(w.text[longer])
            features.append(W.mix(begin + np.uint64(k)))
        yield first, np.concatenate(owners), np.concatenate(features).view(np.int64)


def swapped(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[str]:
    """``text`` with every identity term replaced by the next of its group, and with all left out."""
    following = {a: b for g in groups for a, b in zip(g, g[1:] + g[:1])}
    if not following:
        return []
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, following), key=len, reverse=True)) + r")\b", re.I | re.A)
    if not pattern.search(text):
        return []
    return [pattern.sub(lambda m: following[m.group().lower()], text), pattern.sub("", text)]


@dataclass
class Model:
    """Sorted features with their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        margin = np.full(len(column), self.bias)
        for first, owner, index in known_features(column, self.features):
            np.add.at(margin, owner + first, self.weights[index])
        return 1 / (1 + np.exp(-margin))


def known_features(column: pa.Array, features: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text number, place in ``features``), each pair once."""
    for first, owner, feature in text_features(column):
        if not len(features):
            continue
        at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
        hit = features[at] == feature
        pair = np.unique(owner[hit] * len(features) + at[hit])
        yield first, pair // len(features), pair % len(features)


def choose_features(sample: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """The ``size`` features most associated with the label, from counts added up by Spark."""

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy()
            for first, owner, feature in text_features(batch.column(1)):
                pairs = np.unique(np.stack([feature, owner]), axis=1) if len(feature) else np.empty((2, 0), np.int64)
                found, inverse = np.unique(pairs[0], return_inverse=True)
                toxic = np.bincount(inverse, label[pairs[1] + first], len(found)).astype(np.int64)
                rows = np.bincount(inverse, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(rows), pa.array(toxic)], ["feature", "n", "toxic"])

    both = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    total, positive = both["n"], both["toxic"] or 0
    if not 0 < positive < total:
        return np.empty(0, np.int64)

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, toxic = F.col("n"), F.col("toxic")
    g2 = term(toxic, n * (positive / total)) + term(n - toxic, n * (1 - positive / total))
    g2 += term(positive - toxic, (total - n) * (positive / total))
    g2 += term(total - n - positive + toxic, (total - n) * (1 - positive / total))
    best = (
        sample.mapInArrow(counts, "feature bigint, n bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .withColumn("g2", 2 * g2)
        .filter((n >= MIN_ROWS) & (n < total) & (F.col("g2") >= MIN_G2))
        .orderBy(F.col("g2").desc(), "feature")
        .limit(size)
    )
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64))


def fit(rows: list[np.ndarray], label: np.ndarray, pairs: list[tuple[int, np.ndarray]], size: int, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Weights and bias. ``rows`` holds each row's feature places, ``pairs`` (row, places after a swap)."""
    share = (label.sum() + 0.5) / (len(label) + 1)
    weights, bias = np.zeros(size), float(np.log(share / (1 - share)))
    if not len(label) or label.min() == label.max():
        return weights, bias
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    pair_owner = np.repeat(np.arange(len(pairs)), [len(rows[i]) + len(after) for i, after in pairs])
    none = np.empty(0, np.int64)
    pair_place = np.concatenate([none, *[np.concatenate([rows[i], after]) for i, after in pairs]]).astype(np.int64)
    pair_sign = np.concatenate([none, *[np.repeat([1.0, -1.0], [len(rows[i]), len(after)]) for i, after in pairs]])
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(owner, weights[place], len(rows)))))
        gradient = np.bincount(place, (p - label)[owner], size) / len(rows) + L2 * weights
        if len(pairs):
            change = np.bincount(pair_owner, weights[pair_place] * pair_sign, len(pairs))
            gradient += 2 * fairness * np.bincount(pair_place, change[pair_owner] * pair_sign, size) / len(pairs)
        gradient = np.append(gradient, (p - label).mean())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = FAIRNESS,
) -> Model:
    """A model for ``labels.toxic`` from at most ``sample`` labelled rows outside the held-out fold."""
    chosen = labelled_sample(docs, labels, "toxic", sample, doc_id, text).select(F.col("label").cast("bigint"), "text")
    features = choose_features(chosen)

    def places(column: pa.Array) -> list[np.ndarray]:
        out = [np.empty(0, np.int64)] * len(column)
        for first, owner, index in known_features(column, features):
            for i, own in zip(*(np.unique(owner), np.split(index, np.flatnonzero(np.diff(owner)) + 1))):
                out[i + first] = own
        return out

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            texts = batch.column(1)
            variants = [swapped(t or "", groups) for t in texts.to_pylist()]
            flat = iter(places(pa.array([v for own in variants for v in own], pa.string())))
            after = [[next(flat) for _ in own] for own in variants]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(places(texts), kind), pa.array(after, pa.list_(kind))], ["label", "places", "after"]
            )

    found = chosen.mapInArrow(rows, "label bigint, places array<bigint>, after array<array<bigint>>").collect()
    found.sort(key=lambda r: (r["label"], r["places"], r["after"]))
    own = [np.array(r["places"], np.int64) for r in found]
    pairs = [(i, np.array(after, np.int64)) for i, r in enumerate(found) for after in r["after"]]
    weights, bias = fit(own, np.array([r["label"] for r in found], float), pairs, len(features), fairness)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], ["doc_id", "score"])

    return docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).mapInArrow(
        scores, f"doc_id {id_type}, score double"
    )
