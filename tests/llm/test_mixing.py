from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing

from .conftest import WORD


def shared(sizes: dict, cap: int = 3) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weight[s] / total >= cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * weight[s] / total
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = float(cap * sizes[s])
        open_ -= over
    return target


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
def test_targets_and_takes(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.select("source", "text").collect()]
    sizes = defaultdict(int)
    for source, n in rows:
        sizes[source] += n
    expected = shared(sizes)
    plan = mixing.assign(docs)
    assert plan.columns[: len(docs.columns)] == docs.columns
    size, source_size, target, taken, copies = plan.columns[-5:]
    found = plan.select(F.col("source").alias("s"), F.col(size).alias("n"), F.col(source_size).alias("m"), F.col(target).alias("t"), F.col(taken).alias("k"), F.col(copies).alias("c")).collect()
    assert sorted((r["s"] or "", r["n"]) for r in found) == sorted((s or "", n) for s, n in rows)
    took = defaultdict(int)
    for r in found:
        assert r["m"] == sizes[r["s"]] and abs(r["t"] - expected[r["s"]]) < 1e-6 * max(1, expected[r["s"]])
        assert 0 <= r["k"] <= 3 * r["n"] and sum(c["words"] for c in r["c"]) == r["k"] and len(r["c"]) <= 3
        assert all(0 <= c["position"] <= 1 for c in r["c"])
        took[r["s"]] += r["k"]
    assert all(abs(took[s] - expected[s]) <= 1 for s in sizes)


def test_whole_documents_stay_whole_and_near_target(documents):
    plan = mixing.assign(documents, whole=True)
    rows = plan.select("source", "size", "taken", "target", "copies").collect()
    longest, took, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert all(c["words"] == r["size"] for c in r["copies"])
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        took[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(took[s] - target[s]) <= longest[s] / 2 + 1 for s in took)


def test_positions_follow_the_schedule(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'a', 'b') AS source", "'w' AS text")

    def schedules(sources):
        up = F.expr("array(struct(0D AS at, 0D AS weight), struct(0.5D AS at, 2D AS weight), struct(1D AS at, 2D AS weight))")
        down = F.expr("array(struct(0D AS at, 1.5D AS weight), struct(1D AS at, 1.5D AS weight))")
        return sources.withColumn("knots", F.when(F.col("source") == "a", up).otherwise(down))

    plan = mixing.assign(docs, schedules=schedules)
    early = {r["source"]: r["n"] for r in plan.select("source", F.explode("copies").alias("c")).filter("c.position < 0.5").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(early["a"] - 2000 / 3) < 5 and abs(early["b"] - 1000) < 5


def test_mixture_is_in_order_and_repeatable(odd_docs, no_docs):
    mix = mixing.mixture(odd_docs, whole=True)
    assert mix.columns[: len(odd_docs.columns)] == odd_docs.columns
    places = [r["position"] for r in mix.collect()]
    assert places == sorted(places)
    assert [r["doc_id"] for r in mix.collect()] == [r["doc_id"] for r in mixing.mixture(odd_docs, whole=True).collect()]
    assert mixing.mixture(no_docs).count() == 0


def test_no_python_in_the_plan(documents):
    plan = mixing.mixture(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
