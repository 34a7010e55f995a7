import random
from collections import Counter

import pytest

from fleetlens.llm import trie_join
from fleetlens.llm.graph import components

from .conftest import LOWER, WORD, prose


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """(doc_id, size, component) of each row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def family(seed, n, size, edits):
    """Copies of a text with some words changed, and of copies."""
    draw = random.Random(seed)
    texts = [prose(seed, size).split()]
    while len(texts) < n:
        words = list(draw.choice(texts))
        for _ in range(draw.randrange(edits)):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("hot", [4, 4096])
def test_components_by_brute_force(spark, hot):
    passage = prose(99, 60)
    texts = [*family(1, 60, 80, 4), *family(2, 40, 150, 12), *family(3, 30, 30, 3)]
    texts += [passage + " " + prose(1000 + i, 14) for i in range(60)] + [prose(2000 + i, 5 + i % 9) for i in range(30)]
    texts += ["a b c d e"] * 20 + ["a b"] * 3 + ["x y " * 200, "y x " * 150, "", None]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = trie_join.near_duplicates(docs, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_odd_rows_and_what_stays(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = trie_join.near_duplicates(odd_docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)
    kept = trie_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    expected = {(d, c) for d, n, c in brute(rows) if n}
    left = [(r["doc_id"], shingle_set(r["text"])) for r in kept.collect()]
    assert sum(1 for _, s in left if not s) == sum(1 for _, t in rows if not shingle_set(t))
    assert sorted(d for d, s in left if s) == sorted({c for _, c in expected})
    assert trie_join.near_duplicates(no_docs).count() == 0 and trie_join.keep_one(no_docs).count() == 0


def test_repeated_ids_with_other_texts_stay_apart(spark):
    rows = [(5, prose(1, 40)), (5, prose(2, 40)), (6, prose(1, 40) + " more"), (5, prose(2, 40))]
    kept = trie_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted({rows[0], rows[1]})


def test_split_probes_verify_the_same(spark, monkeypatch):
    rows = list(enumerate(family(7, 50, 90, 5)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(trie_join, "PROBE_CHUNK", 3)
    found = trie_join.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_graph_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 50)]
    edges += [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
