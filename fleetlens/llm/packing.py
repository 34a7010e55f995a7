"""Hierarchical best-fit packing of tokenised documents into sequences (operator 3).

``tokenize`` turns documents into pieces of at most ``capacity`` tokens. ``pack`` places rows
with a length into sequences:

1. Each partition, block by block, places its rows best-fit, longest first. Sequences with
   at most ``slack`` free tokens are done.
2. The underfull ones become rows themselves. Groups of ``fan`` partitions are merged and
   placed best-fit again, until one partition is left. Only underfull sequences move, as
   (number, fill), never their contents.
3. The rounds' small tables are chained and joined once with the rows of the first round.

What a task holds is bounded: a block of rows, or the underfull sequences of ``fan`` tasks.
Best-fit leaves one sequence at most half full to a block, and a sequence over half full can
only take such a one, so of those over half full a block hands on the ``partners`` emptiest.
As long as no more blocks than that meet, none that is held back could have been merged.

Defined cases: a null or empty text is the end token alone; a length over the capacity is an
error; rows that repeat are placed each; an empty table packs into no sequence. ``pack`` keeps
all columns; its own take underscores where the input has their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.frames import free_name, lean, named, own_columns
from fleetlens.llm.words import slices, words
from fleetlens.session import checkpointed

CAPACITY = 4096
END = 1
FAN = 16
PARTNERS = 4096
BLOCK_ROWS = 1 << 17
BLOCK_BYTES = 8 << 20
#: Words a worker remembers, and their ids; beyond, it forgets the half that it met longest ago.
REMEMBERED, REMEMBERED_IDS = 1 << 20, 1 << 22
RUN_WORDS = 1024


class WordEncoder:
    """Token ids of texts, for tokenizers that drop white space and never join across it.

    A text's ids are then those of its words in a row, so each word is encoded once and
    remembered by the 64-bit hash of its bytes, in sorted arrays beside the ids: few bytes a
    word, and texts are put together by array lookups. New words of letters only, each of
    which ends in one token that ends a word, are encoded many at a time and cut apart behind
    these tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends_word[number] = bool(suffix) and token.endswith(suffix)
        self.key = np.empty(0, np.uint64)
        self.start, self.count, self.used = (np.empty(0, np.int32) for _ in range(3))
        self.ids = np.empty(0, "<u4")
        self.round = 0

    def _encoded(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, counts, ids): the words' numbers in the order of the ids, ids per word, and all ids."""
        letters = [i for i, w in enumerate(words) if w.isalpha()] if self.ends_word.any() else []
        others = sorted(set(range(len(words))).difference(letters))
        runs = [letters[i : i + RUN_WORDS] for i in range(0, len(letters), RUN_WORDS)]
        joined = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in run]) for run in runs], add_special_tokens=False)
        order, counts, ids = [], [], []
        for run, e in zip(runs, joined):
            own = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[own]) + 1
            if len(ends) == len(run):
                order += run
                counts.append(np.diff(ends, prepend=0))
                ids.append(own)
            else:
                others += run
        for i, e in zip(others, self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)):
            order.append(i)
            counts.append(np.array([len(e.ids)]))
            ids.append(np.array(e.ids, "<u4"))
        return order, np.concatenate(counts), np.concatenate(ids)

    def _forget(self) -> None:
        """Keep the half of the words that was met last."""
        kept = np.flatnonzero(self.used > np.median(self.used))
        self.key, self.start, self.count, self.used = (x[kept] for x in (self.key, self.start, self.count, self.used))
        total = np.cumsum(self.count)
        self.ids = self.ids[np.repeat(self.start - (total - self.count), self.count) + np.arange(total[-1] if len(total) else 0)]
        self.start = (total - self.count).astype(np.int32)
        if len(self.ids) > REMEMBERED_IDS:
            self.key, self.ids = self.key[:0], self.ids[:0]
            self.start, self.count, self.used = (x[:0] for x in (self.start, self.count, self.used))

    def _learn(self, key: np.ndarray, words: list[str]) -> None:
        order, count, ids = self._encoded(words)
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        key = key[order]
        by_key = np.argsort(key)
        place = np.searchsorted(self.key, key[by_key])
        self.key = np.insert(self.key, place, key[by_key])
        self.start = np.insert(self.start, place, start[by_key])
        self.count = np.insert(self.count, place, count[by_key])
        self.used = np.insert(self.used, place, self.round)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        self.round += 1
        if len(self.key) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self._forget()
        found = words(data, offsets, lower=False)
        key, first, word = np.unique(found.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, key)
        new = np.flatnonzero(np.append(self.key, np.uint64(0))[at] != key) if len(self.key) else np.arange(len(key))
        if len(new):
            raw = data.tobytes()
            places = zip(found.start[first[new]].tolist(), found.end[first[new]].tolist())
            self._learn(key[new], [raw[a:b].decode() for a, b in places])
            at = np.searchsorted(self.key, key)
        self.used[at] = self.round
        count, start = self.count[at][word], self.start[at][word]
        total = np.cumsum(count)
        ids = self.ids[np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.concatenate([[0], total])[found.bounds()].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield ids[a:b].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per file and worker, so that remembered words outlast a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids followed by ``end``.

    ``ids_crc32`` is over the ids as little-endian 32-bit numbers. ``keep_ids`` adds the ids.
    """
    id_field = T.StructField("doc_id", docs.schema[doc_id].dataType)
    schema = T.StructType(
        [id_field, *[T.StructField(n, t) for n, t in (
            ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
        )], *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])]
    )
    last, step = np.array([end], "<u4").tobytes(), 4 * capacity

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for first, until, data, offsets in slices(batch.column(1)):
                part = batch.slice(first, until - first)
                rows: list[tuple] = []
                for i, ids in enumerate(own.encode(data, offsets)):
                    ids += last
                    rows += [
                        (i, k, at // 4, len(ids[at : at + step]) // 4, zlib.crc32(ids[at : at + step]), ids[at : at + step])
                        for k, at in enumerate(range(0, len(ids), step))
                    ]
                index, piece, start, length, crc, ids = zip(*rows) if rows else ([],) * 6
                columns = [
                    part.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).mapInArrow(lean(pieces), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first into the fullest sequence with room: (sequence, offset) per row, and all fills.

    ``free`` has bit r set while some sequence has exactly r tokens free.
    """
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_free: dict[int, list[int]] = {}
    free, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = with_free[room].pop()
            if not with_free[room]:
                free ^= 1 << room
        else:
            room, own = capacity, len(fills)
            fills.append(0)
        sequence[i], offset[i] = own, capacity - room
        fills[own] += length
        room -= length
        if room:
            with_free.setdefault(room, []).append(own)
            free |= 1 << room
    return sequence, offset, np.array(fills, np.int64)


def _place(rows: DataFrame, level: int, length: str, names: dict[str, str], capacity: int, slack: int, partners: int) -> DataFrame:
    """Add sequence, offset, fill and open to the rows; sequences are numbered by level, partition and block."""
    fields = [("sequence", pa.int64(), T.LongType()), ("offset", pa.int64(), T.LongType()),
              ("fill", pa.int64(), T.LongType()), ("open", pa.bool_(), T.BooleanType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(names[n], t) for n, _, t in fields]])
    at = rows.columns.index(length)

    def placed(batches: list[pa.RecordBatch], first: int) -> tuple[pa.Table, int]:
        block = pa.Table.from_batches(batches)
        lengths = block.column(at).to_numpy().astype(np.int64)
        if len(lengths) and (lengths.max() > capacity or lengths.min() < 0):
            raise ValueError(f"a length is not between 0 and {capacity}")
        sequence, offset, fills = best_fit(lengths, capacity)
        underfull = np.flatnonzero(fills < capacity - slack)
        wide = underfull[fills[underfull] * 2 > capacity]
        wide = wide[np.argsort(fills[wide], kind="stable")][:partners]
        is_open = np.zeros(len(fills), bool)
        is_open[underfull[fills[underfull] * 2 <= capacity]] = True
        is_open[wide] = True
        columns = [sequence + first, offset, fills[sequence], is_open[sequence]]
        for (n, kind, _), values in zip(fields, columns):
            block = block.append_column(names[n], pa.array(values, kind))
        return block, len(fills)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (level << 58) + (TaskContext.get().partitionId() << 34)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
                block, used = placed(held, first)
                yield from block.to_batches(max_chunksize=10_000)
                held, first = [], first + used
        if held:
            yield from placed(held, first)[0].to_batches(max_chunksize=10_000)

    return rows.mapInArrow(place, schema)


def pack(
    rows: DataFrame, length: str = "length", capacity: int = CAPACITY, slack: int | None = None,
    fan: int = FAN, partners: int = PARTNERS,
) -> DataFrame:
    """``rows`` with sequence_id and offset: the place of each in a sequence of at most ``capacity``."""
    slack = capacity // 64 if slack is None else slack
    names = {n: free_name(rows, n) for n in ("sequence", "offset", "fill", "open")}
    first = checkpointed(_place(rows, 0, length, names, capacity, slack, partners))
    own = {n: named(c) for n, c in names.items()}
    open_rows = first.filter(own["open"] & (own["offset"] == 0)).select(
        own["sequence"].alias("child"), own["fill"].alias("length")
    )
    plain = {n: n for n in names}
    rounds, partitions, level = [], first.rdd.getNumPartitions(), 0
    while partitions > 1:
        partitions, level = -(-partitions // fan), level + 1
        merged = checkpointed(_place(open_rows.coalesce(partitions), level, "length", plain, capacity, slack, partners))
        rounds.append(merged.select("child", "sequence", "offset"))
        open_rows = merged.filter(F.col("open") & (F.col("offset") == 0)).select(
            F.col("sequence").alias("child"), F.col("fill").alias("length")
        )
    sequence_id, offset = free_name(rows, "sequence_id"), free_name(rows, "offset")
    if not rounds:
        return first.select(*own_columns(rows), own["sequence"].alias(sequence_id), own["offset"].alias(offset))
    chained = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = chained.select(
            F.col("child").alias("_child"), F.col("sequence").alias("_sequence"), F.col("offset").alias("_offset")
        )
        chained = earlier.join(later, F.col("sequence") == F.col("_child"), "left").select(
            "child", F.coalesce("_sequence", "sequence").alias("sequence"),
            (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"),
        )
    moved = chained.select(
        F.col("child").alias("_child"), F.col("sequence").alias("_sequence"), F.col("offset").alias("_moved")
    )
    return first.join(moved, own["sequence"] == F.col("_child"), "left").select(
        *own_columns(rows),
        F.coalesce(F.col("_sequence"), own["sequence"]).alias(sequence_id),
        (own["offset"] + F.coalesce(F.col("_moved"), F.lit(0))).alias(offset),
    )


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids) of packed rows that carry ids; a sequence has ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("offset"), named(ids).alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
