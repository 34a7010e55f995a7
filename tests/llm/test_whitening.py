import math

import numpy as np
import pytest

from fleetlens.llm import whitening


def brute(vectors: list) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(d) for d in ((n * x - s) ** 2).sum(1)]
    centred = ((n * x - s) / n).astype(float)
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return centred, deviation, values[::-1], columns[:, ::-1]


def checked(rows: list, vectors: list) -> None:
    centred, deviation, values, columns = brute(vectors)
    kept = max(r["component"] for r in rows)
    table = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(vectors) * kept == len(table)
    for k in range(1, kept + 1):
        own = [table[i, k] for i in range(len(vectors))]
        white = np.array([r["whitened"] for r in own])
        assert [r["deviation"] for r in own] == deviation
        assert {r["n"] for r in own} == {len(vectors)}
        assert own[0]["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        expected = centred @ columns[:, k - 1] / math.sqrt(values[k - 1])
        assert min(np.abs(white - expected).max(), np.abs(white + expected).max()) < 1e-6
    assert all(r["identity_error"] < 1e-9 for r in rows)


def test_whole_table_by_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = whitening.whiten(table, whitening.fit(table)).collect()
    got = [r.asDict() | {"vec_id": ids[r["vec_id"]]} for r in got]
    checked(got, [r["embedding"] for r in rows])


def test_odd_vectors(spark):
    draw = np.random.default_rng(1)
    good = [list(map(float, v)) for v in draw.normal(size=(60, 5)) * [3, 2, 1, 0.5, 1e-3] + 900]
    odd = [None, [], [1.0] * 4, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1.0] * 7]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(None, v, "y", None) for v in odd]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component string, n int").repartition(7)
    got = whitening.whiten(table, whitening.fit(table)).collect()
    checked(got, good)


def test_a_third_equal_and_repeated_ids(spark):
    draw = np.random.default_rng(2)
    rows = [(None, [0.25, 0.5, 0.75]) if i % 3 == 0 else (7, list(map(float, draw.normal(size=3)))) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = whitening.whiten(table, whitening.fit(table)).collect()
    assert len(got) == 90 * 3 and sum(r["vec_id"] is None for r in got) == 90
    white = np.array([r["whitened"] for r in got if r["component"] == 1])
    assert abs((white**2).mean() - 1) < 1e-9


def test_directions_without_variance_are_no_components(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(50):
        a, b = map(float, draw.integers(-40, 40, 2))
        rows.append((i, [a, b, a + b, 5.0, -a]))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whitening.whiten(table, whitening.fit(table)).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert got[0]["identity_error"] < 1e-6
    same = table.selectExpr("vec_id", "array(1.5D, 2.5D) AS embedding")
    assert whitening.whiten(same, whitening.fit(same)).count() == 0
    assert whitening.whiten(table.limit(1), whitening.fit(table.limit(1))).count() == 0
    assert whitening.whiten(table.limit(0), whitening.fit(table.limit(0))).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [v, v / 3]) for i, v in enumerate([1e9, -3e9, 2.5e10, 7.0, 1e30])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    fit = whitening.fit(table)
    limit = 2**52
    clipped = [[max(-limit, min(limit, v * 1024)) for v in r[1]] for r in rows]
    x = [[math.floor(v) + 100_000 for v in row] for row in clipped]
    assert fit.sums == [sum(c) for c in zip(*x)]
    deviation = [sum((5 * v - s) ** 2 for v, s in zip(row, fit.sums)) for row in x]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table, fit).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
