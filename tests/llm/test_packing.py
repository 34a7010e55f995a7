import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def assert_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["at"], r["length"]))
    for places in by.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= capacity
    return len(by)


def test_pieces_and_places(odd_docs, no_docs):
    tokens = packing.tokenize(odd_docs, PATH, capacity=512, keep_ids=True)
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for r in odd_docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        expected += [(r["doc_id"] or -1, k, at, ids[at : at + 512]) for k, at in enumerate(range(0, len(ids), 512))]
    got = tokens.collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["ids"]) for r in got) == sorted(expected)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in got)
    packed = packing.pack(tokens, capacity=512)
    rows = packed.withColumnRenamed("offset", "at").collect()
    assert len(rows) == len(expected)
    total = sum(len(e[3]) for e in expected)
    assert assert_packed(rows, 512) <= -(-total // 512) + 1
    whole = packing.sequences(packed).collect()
    assert sorted(x for r in whole for x in r["ids"]) == sorted(x for e in expected for x in e[3])
    assert packing.pack(packing.tokenize(no_docs, PATH)).count() == 0


def test_rounds_merge_what_partitions_leave(spark):
    rows = spark.range(0, 300, 1, 40).selectExpr("id", "CAST(30 AS bigint) AS length", "id AS offset", "'x' AS sequence_id")
    packed = packing.pack(rows, capacity=100, slack=0, fan=4)
    assert packed.columns == ["id", "length", "offset", "sequence_id", "sequence_id_", "offset_"]
    found = packed.selectExpr("length", "sequence_id_ AS sequence_id", "offset_ AS at").collect()
    assert len(found) == 300
    # 40 partitions of 7 or 8 rows leave 1 or 2 rows each; merged, three fill a sequence.
    assert assert_packed(found, 100) <= 300 // 3 + 2


def test_best_fit_by_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(50):
        lengths = draw.integers(0, 65, 60)
        sequence, offset, fills = packing.best_fit(lengths, 64)
        free = []
        place = {}
        for i in np.argsort(-lengths, kind="stable"):
            fit = [k for k, room in enumerate(free) if room >= lengths[i]]
            k = min(fit, key=lambda k: free[k]) if fit else len(free)
            if k == len(free):
                free.append(64)
            free[k] -= lengths[i]
            place[i] = k
        assert len(fills) == len(free) and sorted(fills) == sorted(64 - f for f in free)
        assert (np.bincount(sequence, lengths, len(fills)) == fills).all()


def test_too_long_a_row_is_an_error(spark):
    with pytest.raises(Exception, match="between 0 and 10"):
        packing.pack(spark.range(1).selectExpr("11L AS length"), capacity=10).collect()
