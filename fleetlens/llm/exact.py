"""Exact deduplication by a heavy-hitter split (operator 9).

Texts are compared by the SHA-256 of their bytes after lower-casing A-Z only; a null text
counts as empty. Misra-Gries summaries find the digests that a large share of the rows may
have. Their exact sizes and winners, at most ``heavy`` rows, are broadcast, so that rows of
hot groups are settled where they lie. All other rows are grouped by an ordinary shuffle, in
which no group can be hot.

Defined cases: an empty table gives an empty result; of equal texts the row with the largest
id stays, a null id being the least; of rows with equal text and equal id exactly one stays.
Further columns of the input, whatever their names, do not matter to the decision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import free_name, lean, named, own_columns
from fleetlens.llm.sketches import frequent
from fleetlens.session import checkpointed

HEAVY = 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _winner() -> tuple[Column, Column]:
    return F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, digest): the hex SHA-256 of each row's normalised text."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            hexes = [hashlib.sha256((t.as_py() or b"").translate(_LOWER)).hexdigest() for t in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hexes, pa.string())], ["doc_id", "digest"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lean(digest), f"doc_id {id_type}, digest string"
    )


def _digested(docs: DataFrame, doc_id: str, text: str, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Digests of all rows in the shared folder, and the winners of the hot groups (``heavy`` at most)."""
    rows = checkpointed(digests(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("key", F.xxhash64("digest"))
    candidates = F.broadcast(frequent(rows, "key", heavy).select("key"))
    winners = rows.join(candidates, "key", "left_semi").groupBy("digest").agg(*_winner())
    return rows, F.broadcast(winners)


def _settled(rows: DataFrame, winners: DataFrame) -> DataFrame:
    marked = rows.join(winners, "digest", "left")
    hot = marked.filter(F.col("best").isNotNull()).select("doc_id", "digest", "row", "best", "group_size")
    light = marked.filter(F.col("best").isNull()).select("doc_id", "digest", "row")
    both = hot.unionByName(light.join(light.groupBy("digest").agg(*_winner()), "digest"))
    return both.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "digest",
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each row of ``docs``."""
    return _settled(*_digested(docs, doc_id, text, heavy))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    The losers of hot groups leave before any text moves. The rest meets the list of rows
    that stay on id and digest; a row repeated with the same id and text is kept once.
    """
    rows, winners = _digested(docs, doc_id, text, heavy)

    def key(id_column: Column, digest: Column) -> Column:
        return F.concat(digest, F.coalesce(id_column.cast("string"), F.lit("")))

    kept = _settled(rows, winners).filter("kept").select(key(F.col("doc_id"), F.col("digest")).alias("_kept"))
    digest, at = free_name(docs, "_digest"), free_name(docs, "_at")
    lowered = F.translate(F.coalesce(named(text), F.lit("")), _UPPER, _UPPER.lower())
    best = winners.select(F.col("digest").alias("_hot"), F.col("best.doc_id").alias("_hot_id"))
    marked = docs.withColumn(digest, F.sha2(lowered, 256))
    met = marked.join(best, named(digest) == F.col("_hot"), "left").filter(
        F.col("_hot").isNull() | named(doc_id).eqNullSafe(F.col("_hot_id"))
    )
    return (
        met.select(*own_columns(docs), key(named(doc_id), named(digest)).alias(at))
        .join(kept, named(at) == F.col("_kept"), "left_semi")
        .dropDuplicates([at])
        .select(*own_columns(docs))
    )
