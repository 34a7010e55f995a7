"""Jaccard join of shingle sets by a prefix tree (operator 8).

Sets are ordered by one global order of shingles, rarest first. Two sets that link share one
of the first ``n - ceil(3n/4) + 1`` shingles of each, so only those are exchanged, and shingles
of one document, which come first and meet nothing, are not stored at all.

1. ``scan``: one row per document with the size and a 128-bit digest of its set; equal sets are
   one class from here on. The shingles that a large share of the documents have are found
   by Misra-Gries summaries; their summed counts serve as their frequencies.
2. Shingles meet by hash ranges, each slice of documents sending one packed row to a range,
   and those of two documents or more go back to their slice with their frequency. No range
   holds a hot shingle, as hot ones are known before.
3. The sets of a prefix shingle first meet its leader only, the set with the fewest shingles
   of its own, which is the one that edited copies have most in common with. What links is
   one component; pairs of different components that the length bounds allow follow, found
   between classes of equal size and place, never row by row.
4. Candidates are verified in a trie: sorted by size and ordered shingles under the set they
   are probed with, a candidate shares the counted overlap of the path it has in common
   with the one before, and a subtree is left as soon as the remaining lengths cannot reach
   the overlap needed. Sets pass in a stream; nothing holds a group.
5. Components by large and small stars; a document's is the least doc_id in it.

Shingles are known by 48 bits of their hash. No link between different sets is left out and no
list of partners is cut. ``docs`` should be a scan or a stored table, as slices are numbered
by where they lie.

Defined cases: A-Z are lower-cased; a text with fewer than five words is one shingle of all its
words; a text without words, or null, has the empty set and links with nothing; a null doc_id
is never the least unless it is alone; rows that repeat an id are documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import words as W
from fleetlens.llm.frames import free_name, lean, named, own_columns
from fleetlens.llm.graph import components
from fleetlens.llm.sketches import Summary, merged
from fleetlens.session import checkpointed

HOT = 4096
#: Sets under one probe before it is split over tasks.
PROBE_CHUNK = 4096
_U = np.uint64
_MOST = (1 << 14) - 1
_SETS, _COUNTS = 0, 1


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, which is small once compressed if they are sorted."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


class _Slice:
    """The distinct shingles of some texts as sorted numbers of 48 hash bits and 16 bits of text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text, h = W.shingles(W.words(data, offsets))
        n = len(offsets) - 1
        self.pairs = np.unique((h & ~_U(0xFFFF)) | text.astype(np.uint64))
        self.text = (self.pairs & _U(0xFFFF)).astype(np.int64)
        self.size = np.bincount(self.text, minlength=n)
        order = np.argsort(self.text, kind="stable")
        shingle = self.pairs[order] >> _U(16)
        start = np.concatenate([[0], np.cumsum(self.size)])
        self.digest = np.zeros((n, 2), np.uint64)
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(shingle + _U(salt)), dtype=np.uint64)])
            self.digest[:, i] = total[start[1:]] - total[start[:-1]]

    def digests(self) -> pa.Array:
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(self.digest), [None, pa.py_buffer(self.digest.tobytes())])
        return flat.cast(pa.binary())

    def own(self, doc_id: list) -> np.ndarray:
        """Is a text, of those here with its set, the one with the least id? Empty sets are not."""
        best: dict[bytes, int] = {}
        for i in np.flatnonzero(self.size).tolist():
            key = self.digest[i].tobytes()
            other = best.setdefault(key, i)
            if doc_id[i] is not None and (doc_id[other] is None or doc_id[i] < doc_id[other]):
                best[key] = i
        mask = np.zeros(len(self.size), bool)
        mask[list(best.values())] = True
        return mask


def scan(docs: DataFrame, doc_id: str, text: str, hot: int = HOT) -> DataFrame:
    """Documents (doc_id, n, digest, own) and, as rows with a key, summaries (key, count) of shingles."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "digest", "own", "key", "count"]
        summary, id_kind = Summary(hot), None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for first, last, data, offsets in W.slices(batch.column(1)):
                ids = batch.column(0).slice(first, last - first)
                found = _Slice(data, offsets)
                own = found.own(ids.to_pylist())
                shingle = found.pairs[own[found.text]] >> _U(16)
                starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else []
                if len(shingle):
                    summary.add(shingle[starts].astype(np.int64), np.diff(np.append(starts, len(shingle))))
                none = pa.nulls(last - first, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(found.size, pa.int64()), found.digests(), pa.array(own), none, none], names
                )
        if len(summary.keys):
            k = len(summary.keys)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, id_kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.bool_()),
                 pa.array(summary.keys), pa.array(summary.counts)], names,
            )

    texts = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    return texts.mapInArrow(lean(rows), f"doc_id {id_type}, n bigint, digest binary, own boolean, key bigint, count bigint")


def _exchange(docs: DataFrame, doc_id: str, text: str, hot: dict[int, int], ranges: int) -> DataFrame:
    """Sets (digest, n, unique, keys) that have a prefix shingle of two documents or more.

    ``keys`` are the set's shingles of two documents or more in the global order, as numbers of
    14 bits of frequency and 48 of hash; ``unique`` counts the others.
    """
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[k] for k in sorted(hot)], np.int64)
    wire = "place bigint, kind int, payload binary"

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        place, kind, payload = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["place", "kind", "payload"]
        )

    def counted(keys: np.ndarray, texts: np.ndarray) -> bytes:
        """Ordered keys with their texts, for the slice they came from."""
        return planes(keys) + texts.astype("<u2").tobytes()

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, data, offsets in W.slices(batch.column(1)):
                found = _Slice(data, offsets)
                own = found.own(batch.column(0).slice(first, last - first).to_pylist())
                pairs = found.pairs[own[found.text]]
                if not len(pairs):
                    continue
                slice_id += 1
                address = np.int64(slice_id).tobytes()
                shingle = pairs >> _U(16)
                rows = [(0, _SETS, address + found.size.astype("<u4").tobytes() + found.digest.tobytes())]
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, shingle), len(hot_keys) - 1)
                    is_hot = hot_keys[at] == shingle
                    if is_hot.any():
                        often = np.clip(hot_counts[at[is_hot]], 2, _MOST).astype(np.uint64)
                        keys = (often << _U(48)) | shingle[is_hot]
                        rows.append((0, _COUNTS, address + counted(keys, pairs[is_hot] & _U(0xFFFF))))
                        pairs, shingle = pairs[~is_hot], shingle[~is_hot]
                owner = ((shingle >> _U(16)) * _U(ranges)) >> _U(32)
                cuts = np.searchsorted(owner, np.arange(ranges + 1).astype(np.uint64))
                yield batch_of([(int(slice_id % ranges), k, p) for _, k, p in rows])
                sent = [(i, 2, address + planes(pairs[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                for i in range(0, len(sent), 256):
                    yield batch_of(sent[i : i + 256])

    def count(table: pa.Table) -> pa.Table:
        """Frequencies within a range of hashes; what is known already passes through."""
        rows: list[tuple[int, int, bytes]] = []
        pairs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
            payload = payload.as_py()
            address = int(np.frombuffer(payload[:8], np.int64)[0])
            if kind in (_SETS, _COUNTS):
                rows.append((address, kind, payload[8:]))
            else:
                pairs.append(from_planes(payload[8:]))
                owners.append(np.full(len(pairs[-1]), address))
        pair, owner = np.concatenate(pairs), np.concatenate(owners)
        order = np.argsort(pair >> _U(16), kind="stable")
        pair, owner = pair[order], owner[order]
        shingle = pair >> _U(16)
        if len(shingle):
            first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            often = np.repeat(np.diff(np.append(first, len(shingle))), np.diff(np.append(first, len(shingle))))
            shared = often > 1
            keys = (np.minimum(often[shared], _MOST).astype(np.uint64) << _U(48)) | shingle[shared]
            text, owner = pair[shared] & _U(0xFFFF), owner[shared]
            order = np.argsort(owner, kind="stable")
            keys, text, owner = keys[order], text[order], owner[order]
            ids, start = np.unique(owner, return_index=True)
            for slice_id, a, b in zip(ids.tolist(), start, np.append(start[1:], len(owner))):
                rows.append((slice_id, _COUNTS, counted(keys[a:b], text[a:b])))
        return pa.Table.from_batches([batch_of(rows)]) if rows else pa.table(
            {"place": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())}
        )

    def gather(table: pa.Table) -> pa.Table:
        keys, texts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        size, digest = np.empty(0, np.int64), b""
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
            payload = payload.as_py()
            if kind == _SETS:
                n = len(payload) // 20
                size, digest = np.frombuffer(payload[: 4 * n], "<u4").astype(np.int64), payload[4 * n :]
            else:
                n = len(payload) // 10
                keys.append(from_planes(payload[: 8 * n]))
                texts.append(np.frombuffer(payload[8 * n :], "<u2").astype(np.int64))
        key, text = np.concatenate(keys), np.concatenate(texts)
        order = np.lexsort((key, text))
        key, text = key[order].astype(np.int64), text[order]
        cuts = np.searchsorted(text, np.arange(len(size) + 1))
        shared = np.diff(cuts)
        unique = size - shared
        prefix = size - (3 * size + 3) // 4 + 1 - unique
        kept = np.flatnonzero((prefix > 0) & (shared > 0))
        return pa.table(
            {
                "digest": pa.array([digest[16 * i : 16 * i + 16] for i in kept.tolist()], pa.binary()),
                "n": pa.array(size[kept], pa.int64()),
                "unique": pa.array(unique[kept], pa.int64()),
                "keys": pa.array([key[cuts[i] : cuts[i + 1]] for i in kept.tolist()], pa.list_(pa.int64())),
            }
        )

    texts = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    sent = texts.mapInArrow(lean(send), wire)
    back = sent.groupBy("place").applyInArrow(count, wire)
    return back.groupBy("place").applyInArrow(gather, "digest binary, n bigint, unique bigint, keys array<bigint>")


def _may_link(a_rest: Column, b_rest: Column, a_n: Column, b_n: Column) -> Column:
    """Can sets whose first common shingle leaves these many from it on reach 75 % overlap?"""
    return 7 * F.least(a_rest, b_rest) >= 3 * (a_n + b_n)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that link: 100 * intersection >= 75 * union."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("_count"))
    chunked = pairs.join(counts, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_count") / PROBE_CHUNK)).alias("chunk")
    )
    parts = sets.select("id", "n", "unique", "keys")
    candidates = chunked.join(parts, F.col("b") == F.col("id")).select("a", "chunk", "b", "n", "unique", "keys")
    probes = chunked.select("a", "chunk").distinct().join(parts, F.col("a") == F.col("id")).select(
        "a", "chunk", F.lit(-1).cast("bigint").alias("b"), "n", "unique", "keys"
    )
    order = ["a", "chunk", F.col("b") >= 0, "n", "unique", "keys"]
    stream = candidates.unionByName(probes).repartition("a", "chunk").sortWithinPartitions(*order)
    return stream.drop("chunk").mapInArrow(lean(_walk), "a bigint, b bigint")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the tries of probes one after another; candidates come in the order of their paths."""
    probe = np.empty(0, np.int64)
    probe_n = 0
    shape: tuple = ()
    path = np.empty(0, np.int64)
    overlap = np.zeros(1, np.int64)
    dead = -1
    for batch in batches:
        column = batch.column("keys")
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        linked: list[tuple[int, int]] = []
        numbers = (batch.column(c).to_numpy() for c in ("a", "b", "n", "unique"))
        for i, (a, b, n, unique) in enumerate(zip(*(x.tolist() for x in numbers))):
            keys = values[offsets[i] : offsets[i + 1]]
            if b < 0:
                probe, probe_n, shape = keys.copy(), n, ()
                continue
            need = -(-3 * (n + probe_n) // 7)
            common = 0
            if shape == (n, unique):
                upto = min(len(path), len(keys))
                differ = np.flatnonzero(path[:upto] != keys[:upto])
                common = int(differ[0]) if len(differ) else upto
                if 0 <= dead <= common:
                    continue
            else:
                overlap = np.zeros(1, np.int64)
            at = np.searchsorted(probe, keys[common:])
            found = probe[np.minimum(at, len(probe) - 1)] == keys[common:] if len(probe) else np.zeros(len(at), bool)
            overlap = np.concatenate([overlap[: common + 1], overlap[common] + np.cumsum(found)])
            left = np.minimum(len(keys) - np.arange(common + 1, len(keys) + 1), len(probe) - at - found)
            short = np.flatnonzero(overlap[common + 1 :] + left < need)
            dead = common + 1 + int(short[0]) if len(short) else -1
            path, shape = keys.copy(), (n, unique)
            if dead < 0 and overlap[-1] >= need:
                linked.append((a, b))
        if linked:
            first, second = zip(*linked)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])


def link_sets(sets: DataFrame) -> DataFrame:
    """(node, root): components of linked sets; sets without a link are left out."""
    prefix = F.slice("keys", F.lit(1), (F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - F.col("unique")).cast("int"))
    entries = checkpointed(
        sets.select("id", "n", "unique", F.posexplode(prefix).alias("at", "key")).select(
            "key", "id", "n", "unique", (F.col("n") - F.col("unique") - F.col("at")).alias("rest")
        )
    )
    leaders = entries.groupBy("key").agg(F.min(F.struct("unique", "id", "n", "rest")).alias("lead"), F.count("*").alias("sets"))
    met = entries.join(leaders.filter("sets > 1").drop("sets"), "key").filter(
        (F.col("id") != F.col("lead.id"))
        & _may_link(F.col("rest"), F.col("lead.rest"), F.col("n"), F.col("lead.n"))
    )
    first = checkpointed(verify(met.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), sets))
    roots = components(first)
    placed = checkpointed(
        entries.join(roots, F.col("id") == F.col("node"), "left").select(
            "key", "id", "n", "rest", F.coalesce("root", "id").alias("root")
        )
    )
    mixed = placed.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).filter("_least < _most")
    open_rows = placed.join(mixed.select("key"), "key", "left_semi")
    classes = open_rows.groupBy("key", "root", "n", "rest").agg(F.count("*").alias("_sets")).drop("_sets")
    one, two = (classes.select(*[F.col(c).alias(f"{c}{i}") for c in classes.columns]) for i in (1, 2))
    allowed = one.join(
        two,
        (F.col("key1") == F.col("key2")) & (F.col("root1") < F.col("root2"))
        & _may_link(F.col("rest1"), F.col("rest2"), F.col("n1"), F.col("n2")),
    ).drop("key2")
    side = [open_rows.select(F.col("key").alias(f"k{i}"), F.col("id").alias(f"id{i}"), *[
        F.col(c).alias(f"{c}_{i}") for c in ("root", "n", "rest")]) for i in (1, 2)]

    def same(i: int) -> Column:
        return (F.col("key1") == F.col(f"k{i}")) & (F.col(f"root{i}") == F.col(f"root_{i}")) & (
            F.col(f"n{i}") == F.col(f"n_{i}")) & (F.col(f"rest{i}") == F.col(f"rest_{i}"))

    rest = allowed.join(side[0], same(1)).join(side[1], same(2)).select(
        F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")
    )
    return components(first.union(verify(rest.distinct(), sets)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id, digest, component), one row for each row of ``docs``.

    ``digest`` is that of the set, ``component`` names the component also where ids repeat;
    both are null without words.
    """
    found = checkpointed(scan(docs, doc_id, text, hot))
    rows = found.filter(F.col("key").isNull()).select("doc_id", "n", "digest", "own")
    total = rows.filter("own").agg(F.sum("n")).first()[0] or 0
    often = merged(found.filter(F.col("key").isNotNull()), total, hot)
    hottest = {r["key"]: r["estimate"] for r in often.collect()}
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = _exchange(docs, doc_id, text, hottest, ranges).dropDuplicates(["digest"])
    sets = checkpointed(sets.withColumn("id", F.monotonically_increasing_id()))
    roots = link_sets(sets)
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    linked = (
        sets.select("id", F.col("digest").alias("_digest")).join(roots, F.col("id") == F.col("node"))
        .select("_digest", "root")
        .join(classes, F.col("_digest") == F.col("digest"))
        .select("digest", "root", "least")
    )
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    placed = linked.join(least, "root").select(F.col("digest").alias("_linked"), "root", "component")
    of_class = classes.join(placed, F.col("digest") == F.col("_linked"), "left").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "least").alias("_least"),
        F.coalesce(F.col("root").cast("string"), F.hex("digest")).alias("component"),
    )
    joined = rows.join(of_class, (F.col("digest") == F.col("_digest")) & (F.col("n") > 0), "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.hex("digest")).alias("digest"), "component",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row of ``docs`` per component, that with the least doc_id, and all rows without words."""
    groups = near_duplicates(docs, doc_id, text, hot).filter(F.col("digest").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    kept = groups.groupBy("component").agg(first).select(
        F.concat_ws(":", F.col("first.digest"), F.col("first.doc_id").cast("string")).alias("_kept")
    )
    name, at = free_name(docs, "_set"), free_name(docs, "_at")
    place = docs.columns.index(text)

    def with_digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.slices(batch.column(place)):
                part = batch.slice(first, last - first)
                found = _Slice(data, offsets)
                digests = [d.hex().upper() if n else None for d, n in zip(found.digests().to_pylist(), found.size.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.string())], [*part.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    key = F.when(named(name).isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(
        F.concat_ws(":", named(name), named(doc_id).cast("string"))
    )
    marked = docs.mapInArrow(lean(with_digest), schema).withColumn(at, key)
    met = marked.join(kept, named(at) == F.col("_kept"), "left").filter(F.col("_kept").isNotNull() | named(name).isNull())
    return met.dropDuplicates([at]).select(*own_columns(docs))
