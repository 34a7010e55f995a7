"""Frequent keys of a table by mergeable Misra-Gries summaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Summary:
    """At most ``size`` keys with counts; a count is too low by at most total / (size + 1)."""

    def __init__(self, size: int):
        self.size = size
        self.keys = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Count keys, or different keys with their counts."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        keys, inverse = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        if len(keys) > self.size:
            counts -= np.partition(counts, -self.size - 1)[-self.size - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def merged(summaries: DataFrame, total: int, size: int) -> DataFrame:
    """(key, estimate) of the summed summaries above total / (size + 1): at most ``size`` rows.

    Estimates add up to ``total`` at most, which bounds the rows. A key with more than twice
    that share is always among them, as its summaries miss total / (size + 1) at most.
    """
    return (
        summaries.groupBy("key")
        .agg(F.sum("count").alias("estimate"))
        .filter(F.col("estimate") * (size + 1) > total)
    )


def frequent(table: DataFrame, key: str, size: int) -> DataFrame:
    """(key, estimate) of the frequent values of a bigint column; nulls count for nothing."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(size)
        for batch in batches:
            own.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(own.keys), pa.array(own.counts)], ["key", "count"])

    return merged(table.select(key).mapInArrow(summarise, "key bigint, count bigint"), table.count(), size)
