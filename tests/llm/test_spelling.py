import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import spelling

from .conftest import LOWER, SCHEMA

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows) -> Counter:
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    return counts


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows) -> dict:
    n = {w: c for w, c in brute_words(rows).items() if c >= 2}
    # words near each other agree once a letter is taken from one, or from both at one place
    without: dict[str, set] = {}
    holes: dict[tuple, set] = {}
    for w in n:
        for k in range(len(w)):
            without.setdefault(w[:k] + w[k + 1 :], set()).add(w)
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    out = {}
    for w in n:
        cut = [(w[:k], w[k + 1 :]) for k in range(len(w))]
        near = {*without.get(w, ()), *(a + b for a, b in cut if a + b in n), *(v for c in cut for v in holes[c])} - {w}
        form = min(near, key=lambda v: (-n[v], v), default=None)
        form = form if form and n[form] >= 10 * n[w] else None
        out[w] = [n[w], len(near), form, n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def found(docs) -> dict:
    rows = spelling.variants(docs).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def test_whole_table_by_brute_force(documents):
    expected = brute((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    assert found(documents) == expected
    assert any(row[2] for row in expected.values())


def test_chains_of_forms_and_ties(spark):
    said = ["abcdefgh"] * 1200 + ["abcdefghi"] * 110 + ["abcdefgHIJ"] * 10 + ["xbcdefgh"] * 1200 + ["zbcdefgh"] * 3 + ["ÀÉÎÕÜßÿ"] * 40
    said += ["ÀÉÎÕÜß"] + ["àéîõüßÿ"] * 2 + ["ÀÉÎÕÜß÷"] * 4 + ["w" * 400] * 40 + ["w" * 399] * 3 + ["hgfedcba"] * 5
    rows = [(None if i % 3 else i, w, None, None, None, None, None, None, None, None, None) for i, w in enumerate(said)]
    rows += [(1, None, *[None] * 9), (2, "", *[None] * 9), (3, " ".join(["same word"] * 3), *[None] * 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = brute((r[0], r[1]) for r in rows)
    got = found(docs)
    assert got == expected
    assert got["abcdefghij"][2] == "abcdefghi" and got["abcdefghij"][4] == got["abcdefghi"][2]


@pytest.mark.parametrize("chunk, cell", [(7, 2), (64, 512)])
def test_chunks_lose_nothing(spark, monkeypatch, chunk, cell):
    """Small chunks, many groups: a hot cell of words that all have the same letters but one."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "CELL", cell)
    draw = np.random.default_rng(5)
    said = ["".join(draw.choice(list("ab"), 8)) + "".join(draw.choice(list("abcé"), draw.integers(0, 3))) for _ in range(900)] * 2
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(said)], "doc_id bigint, text string")
    assert found(docs) == brute(enumerate(said))


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    assert found(odd_docs) == brute((r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect())
    assert found(no_docs) == {}


def test_runs_of_any_length_and_their_checksums():
    texts = ["a" * 7, "Ab" * 2000 + "é", "", "xÿ" * 9 + "Ÿ" + "yyyyyyyy", "sevenletters Ωeightletters"]
    for k in range(120):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        prefix = np.full(len(texts), zlib.crc32(f"{k}:".encode()), np.uint32)
        got = Counter(v.as_py().decode("latin-1") for v in spelling.runs(data, offsets, prefix))
        assert got == brute_words((k, t) for t in texts)


def test_near_pairs_are_those_of_one_edit():
    words = sorted({"abcdefg", "abcdegf", "abcdefx", "abcdef", "abcdefgg", "aabcdefg", "gfedcba", "bcdefgh", "abcxdefg"}, key=len)
    columns = {s: [w for w in words if len(w) == s] for s in (6, 7, 8)}
    blocks = {s: spelling._Block(pa.array([w.encode() for w in c]), np.arange(1, len(c) + 1)) for s, c in columns.items()}
    for a, b in ((6, 7), (7, 7), (7, 8), (8, 8)):
        i, j = spelling.near_pairs(blocks[a], blocks[b], a == b)
        got = {(columns[a][x], columns[b][y]) for x, y in zip(i, j)}
        pairs = [(v, w) for x, v in enumerate(columns[a]) for y, w in enumerate(columns[b]) if a != b or x < y]
        assert got == {p for p in pairs if one_edit(*p)}
