"""Spelling variant grouping by blocked Gram matrices of letter counts (operator 11).

Words are runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, counted over all rows. Two
words are near if one inserted, deleted or replaced code point turns one into the other. Such
words differ by at most 2 in the squared distance of their letter counts, and their lengths by
at most 1.

The alphabet is split into groups of letters of equal frequency. A word's cell is its length
and its number of letters of each group; near words lie in the same cell, or in cells where
one letter moved from group to group, or where one letter is missing. More words make more
groups, so that cells stay small. A cell with many words is cut into chunks. Each chunk meets,
in order, its own words, the later chunks of its cell and the words of neighbouring cells: one
numpy product of letter counts gives the squared distances of a chunk to a slice of words,
those of at most 2 are compared letter by letter, and the counts and best partners of each
word leave the task, not the pairs. A task holds one chunk and one slice, whatever the sizes.

Every near pair is found: nothing is capped. A form has at least ``ratio`` times the
occurrences of its word, so chains of forms are short, and roots are found by pointer doubling.

Defined cases: null and empty texts have no words; a null id counts as the empty text where
runs are chosen for deletion; rows that repeat count again; an empty table gives no rows; words
of any length are compared whole. Further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import named
from fleetlens.llm.words import slices
from fleetlens.session import checkpointed

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: A run is changed if its checksum is divisible by this.
CHANGED = 31
#: Words to a cell that the number of letter groups aims at, and words and letters of a chunk or slice.
CELL, CHUNK, SLICE, LETTERS = 512, 2048, 4096, 1 << 20
MOST_GROUPS = 12
#: Different words a task counts before it hands them on.
HELD = 1 << 18

_LEAD = 0xC3
_FIRST_HIGH = 0xC0
_ALPHABET = [*range(97, 123), *range(_FIRST_HIGH, 0x100)]
_COLUMN = np.zeros(256, np.int64)
_COLUMN[_ALPHABET] = np.arange(len(_ALPHABET))
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Runs longer than this have their checksum taken one by one.
_VECTOR_BYTES = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from the crc32 of what stands before it."""
    order = np.argsort(-size, kind="stable")
    start, size, state = start[order], size[order], ~prefix[order]
    long = int(np.searchsorted(-size, -_VECTOR_BYTES))
    for i in range(long):
        state[i] = ~np.uint32(zlib.crc32(data[start[i] : start[i] + size[i]], int(~state[i])))
    for at in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -at))
        own = state[long:n]
        state[long:n] = _CRC[(own ^ data[start[long:n] + at]) & 0xFF] ^ (own >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), buffers)


def runs(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, least: int = LEAST_LENGTH) -> pa.Array:
    """Changed words of ``least`` letters or more of some texts, one byte a letter.

    U+00C0 to U+00FF are the byte 0xC3 and one after it, and 0xC3 is the lead of nothing else.
    """
    led = np.zeros(len(data), bool)
    led[1:] = data[:-1] == _LEAD
    inside = _IS_LETTER[data] | (data == _LEAD) | led
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] |= inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
    letters = end - start - (leads[end] - leads[start])
    long = letters >= least
    start, end, letters = start[long], end[long], letters[long]
    lowered = _LOWER[data]
    text = np.searchsorted(offsets[1:], start, side="right")
    checksum = _checksums(lowered, start, end - start, prefix[text])
    places = _gather(start, end - start)
    single = np.where(led, data + np.uint8(64), lowered)[places][data[places] != _LEAD]
    changed = checksum % CHANGED == 0
    drop = (np.cumsum(letters) - letters + checksum.astype(np.int64) % np.maximum(letters, 1))[changed]
    single, letters = np.delete(single, drop), letters - changed
    keep = letters >= least
    return _binary(single[np.repeat(keep, letters)], letters[keep])


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): every word of all rows, one byte a letter, and its occurrences."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            ids = [f"{i or ''}:".encode() for i in batch.column(0).to_pylist()]
            prefix = np.array([zlib.crc32(i) for i in ids], np.uint32)
            for first, last, data, offsets in slices(batch.column(1)):
                found = pc.value_counts(runs(data, offsets, prefix[first:last], least))
                held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                size += len(found)
            if size > HELD:
                held = [summed()]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches(1 << 16)
                    held, size = [], 0
        if held:
            yield from summed().to_batches(1 << 16)

    own = docs.select(named(doc_id).cast("string").alias("doc_id"), named(text).alias("text"))
    return own.mapInArrow(_as_binary(count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _as_binary(made):
    def narrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in made(batches):
            columns = [c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return narrow


def letter_groups(vocabulary: DataFrame, total: int) -> list[str]:
    """The alphabet split into groups of about equal frequency, as many as keep cells small."""
    size = 2
    while size < MOST_GROUPS and total / math.comb(LEAST_LENGTH + size, size - 1) > CELL:
        size += 1
    letters = F.explode(F.split(F.decode("word", "ISO-8859-1"), "")).alias("letter")
    counts = {r["letter"]: r["n"] for r in vocabulary.select(letters).groupBy("letter").agg(F.count("*").alias("n")).collect()}
    groups, weights = [""] * size, [0] * size
    for letter in sorted(map(chr, _ALPHABET), key=lambda c: (-counts.get(c, 0), c)):
        least = weights.index(min(weights))
        groups[least] += letter
        weights[least] += counts.get(letter, 0)
    return groups


def _cell(counts: list[Column]) -> Column:
    return F.concat_ws(",", *counts)


def _meetings(vocabulary: DataFrame, groups: list[str]) -> DataFrame:
    """(cell, chunk, side, word, n): each chunk's own words (side 0) and all words that meet it (side 1)."""
    text = F.decode("word", "ISO-8859-1")
    size = F.length("word")
    counts = [size - F.length(F.translate(text, letters, "")) for letters in groups]
    placed = vocabulary.select("word", "n", size.alias("size"), F.array(*counts).alias("counts"))
    placed = placed.withColumn("own", F.concat_ws(",", F.transform("counts", lambda c: c.cast("string"))))
    chunk_words = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(LETTERS) / F.col("size"))))
    cells = placed.groupBy("own").agg(F.ceil(F.count("*") / F.first(chunk_words)).cast("int").alias("chunks"))
    placed = placed.join(cells, "own").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    placed = checkpointed(placed.drop("chunks"))

    def moved(i: int | None, j: int | None) -> Column:
        """The cell with one letter more of group i and one less of group j."""
        at = [F.get("counts", F.lit(k)) + ((k == i) - (k == j)) for k in range(len(groups))]
        return F.when(F.get("counts", F.lit(j)) > 0, _cell(at)) if j is not None else _cell(at)

    span = range(len(groups))
    others = F.array_compact(F.array(*[moved(i, j) for j in span for i in range(j)], *[moved(None, j) for j in span]))
    away = placed.select("word", "n", F.explode(others).alias("cell")).join(cells.withColumnRenamed("own", "cell"), "cell")
    away = away.select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), "word", "n")
    own = placed.select(F.col("own").alias("cell"), "chunk", F.lit(0).alias("side"), "word", "n")
    later = placed.filter("chunk > 0").select(
        F.col("own").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("chunk"), F.lit(1).alias("side"), "word", "n"
    )
    return own.unionAll(later).unionAll(away)


class _Block:
    """Words as letters in rows of equal width, their letter counts, and their order by count, then by word."""

    def __init__(self, column: pa.Array, n: np.ndarray):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        self.n, self.column = n, column
        self.size = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), self.size)
        letters = len(_ALPHABET)
        counts = np.bincount(row * letters + _COLUMN[flat], minlength=len(n) * letters).reshape(len(n), letters)
        half = (counts.astype(np.int64) ** 2).sum(1) / 2.0
        one = np.ones(len(n))
        # single precision is exact up to 2**24; longer words are multiplied in double precision
        self.counts = counts.astype(np.float32 if half.max(initial=0) < 1 << 20 else np.float64)
        self.left = np.column_stack([self.counts, -half, one]).astype(self.counts.dtype)
        self.right = np.column_stack([self.counts, one, -half]).astype(self.counts.dtype)
        width = int(self.size.max(initial=1))
        self.letters = np.zeros((len(n), width), np.uint8)
        self.letters[row, _gather(np.zeros(len(n), np.int64), self.size)] = flat
        order = np.lexsort((np.ascontiguousarray(self.letters).view(f"S{width}").ravel(), -n))
        self.rank = np.empty(len(n), np.int64)
        self.rank[order] = np.arange(len(n))


def _one_edit(a: np.ndarray, b: np.ndarray, size_a: int, size_b: np.ndarray) -> np.ndarray:
    """Do rows of ``a`` become those of ``b``, as long or one letter longer, by one edit?"""
    same = size_b == size_a
    near = np.zeros(len(a), bool)
    near[same] = (a[same, :size_a] != b[same, :size_a]).sum(1) == 1
    one, two = a[~same, :size_a], b[~same]
    if len(one):
        ahead = np.logical_and.accumulate(one == two[:, :size_a], axis=1).sum(1)
        behind = np.logical_and.accumulate((one == two[:, 1 : size_a + 1])[:, ::-1], axis=1).sum(1)
        near[~same] = ahead + behind >= size_a
    return near


def near_pairs(left: _Block, right: _Block, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words: those of ``left`` have one length, those of ``right`` that or one more."""
    minus_half = left.left @ right.right.T
    i, j = np.nonzero(minus_half > -1.25)
    if within:
        i, j = i[i < j], j[i < j]
    size, step = int(left.size[0]), max(1, LETTERS * 4 // int(left.size[0]))
    kept = [
        _one_edit(left.letters[i[k : k + step]], right.letters[j[k : k + step]], size, right.size[j[k : k + step]])
        for k in range(0, len(i), step)
    ]
    near = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[near], j[near]


def _told(block: _Block, own: np.ndarray, partner: np.ndarray, other: _Block) -> pa.RecordBatch:
    """One row for each word of ``own``: how many partners here, and the best of them."""
    order = np.lexsort((other.rank[partner], own))
    own, partner = own[order], partner[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    best = partner[first]
    return pa.RecordBatch.from_arrays(
        [
            block.column.take(pa.array(own[first])).cast(pa.binary()), pa.array(np.diff(np.append(first, len(own)))),
            pa.array(other.n[best]), other.column.take(pa.array(best)).cast(pa.binary()),
        ],
        ["word", "n_near", "form_n", "form"],
    )


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, side 0 first: hold a chunk, compare the slices that follow with it."""
    held_key, held, block = None, [], None

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal block, held
        table = pa.Table.from_batches(held).combine_chunks()
        block, held = _Block(table["word"].combine_chunks(), table["n"].to_numpy()), []
        i, j = near_pairs(block, block, True)
        yield _told(block, np.concatenate([i, j]), np.concatenate([j, i]), block)

    for batch in batches:
        cells = batch.column(0).dictionary_encode().indices.to_numpy()
        chunk, side = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
        bounds = [0, *change.tolist(), len(cells)]
        for first, last in zip(bounds, bounds[1:]):
            if first == last:
                continue
            key, part = (batch.column(0)[first].as_py(), int(chunk[first])), batch.slice(first, last - first).select(["word", "n"])
            if side[first] == 0:
                if held and held_key != key:
                    yield from closed()
                held_key = key
                held.append(part)
                continue
            if held:
                yield from closed()
            if key != held_key:
                raise ValueError("a slice without its chunk")
            size = np.asarray(pc.binary_length(part.column(0)))
            ends = np.maximum(np.cumsum(size) // LETTERS, np.arange(len(size)) // SLICE)
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(size)]
            for a, b in zip(cuts, cuts[1:]):
                other = _Block(part.column(0).slice(a, b - a), part.column(1).slice(a, b - a).to_numpy())
                i, j = near_pairs(block, other, False)
                if len(i):
                    yield _told(block, i, j, other)
                    yield _told(other, j, i, block)
    if held:
        yield from closed()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words of ``vocabulary`` (word, n) with a near one."""
    groups = letter_groups(vocabulary, vocabulary.count())
    met = _meetings(vocabulary, groups).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "side")
    told = met.mapInArrow(_meet, "word binary, n_near bigint, form_n bigint, form binary")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")
    )


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root): every word that occurs often enough, and what it may be a variant of."""
    vocabulary = checkpointed(words(docs, doc_id, text, least_length).filter(F.col("n") >= least_count))
    found = vocabulary.join(near_words(vocabulary), "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = checkpointed(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
        )
    )
    most = found.agg(F.max("form_n")).first()[0] or 1
    chains = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # each form has ``ratio`` times the occurrences of its word, so a chain has at most so many steps
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, ratio)) + 1))):
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chains = chains.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    spelled = {c: F.decode(c, "ISO-8859-1").alias(c) for c in ("word", "form", "root")}
    return found.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word")).select(
        spelled["word"], "n", "n_near", spelled["form"], "form_n", spelled["root"]
    )
