import hashlib
from collections import Counter

from fleetlens.llm import exact
from fleetlens.llm.sketches import Summary, frequent

from .conftest import LOWER


def test_groups_by_brute_force(odd_docs):
    rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in odd_docs.collect()]
    sizes = Counter(t for _, t in rows)
    best = {t: max((d for d, u in rows if u == t and d is not None), default=None) for t in sizes}
    expected = Counter((d, best[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    for heavy in (1, 1024):
        found = exact.exact_groups(odd_docs, heavy=heavy).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in found) == expected
        kept = [r for r in found if r["kept"]]
        assert Counter(r["digest"] for r in kept) == Counter({r["digest"]: 1 for r in found})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_keeps_columns_and_one_row_of_each_text(odd_docs):
    left = exact.drop_exact_duplicates(odd_docs, heavy=1)
    assert left.columns == odd_docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in left.collect()]
    assert sorted(texts) == sorted({(r["text"] or "").translate(LOWER) for r in odd_docs.collect()})


def test_empty_table(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.drop_exact_duplicates(no_docs).count() == 0


def test_summary_never_misses_a_frequent_key():
    import numpy as np

    values = np.random.default_rng(0).zipf(1.3, 50_000) % 5000
    summary = Summary(64)
    for part in np.array_split(values, 37):
        summary.add(part.astype(np.int64))
    counts = Counter(values.tolist())
    got = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert len(got) <= 64
    for key, n in counts.items():
        assert got.get(key, 0) <= n
        assert got.get(key, 0) >= n - len(values) / 65


def test_frequent_holds_hot_keys_and_is_bounded(spark):
    table = spark.range(6000).selectExpr("IF(id % 3 = 0, -1, id) AS key")
    found = {r["key"] for r in frequent(table, "key", 16).collect()}
    assert -1 in found and len(found) <= 16
