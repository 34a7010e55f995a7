"""Folds and bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import named

FOLDS = 4
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id as text in the fold that no label is learnt from? Not for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled ids outside the held-out fold, lowest hash first.

    Null ids and labels are left out; of several labels of one id the lowest counts, of several
    rows of one id the least text, so there are at most ``sample`` rows however often an id is
    repeated. The ids are the proven size of what is broadcast.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (
        usable.groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    texts = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
