import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decision_list

from .conftest import WORD


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
def test_statistics_by_brute_force(table, request):
    docs = request.getfixturevalue(table)
    judged, col = decision_list.judge(docs, [])
    found = judged.select("text", *[col[n].alias(f"_{n}") for n in [*decision_list.BASE, "base_failed", "kept"]]).collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r)[1:7] == counts(r["text"])
        assert r["_kept"] == (not r["_base_failed"])


def test_learns_planted_rules(spark):
    draw = random.Random(0)
    rows = []
    for i in range(600):
        a, b = draw.random(), draw.random()
        rows.append((a > 0.7 and b < 0.5, i % 3 > 0, a, b, draw.random()))
    table = spark.createDataFrame(rows, "reject boolean, grow boolean, a double, b double, c double")
    rules = decision_list.learn_from(table, ["a", "b", "c"])
    assert rules
    assert {c.feature for c in rules[0].conditions} == {"a", "b"}
    hit = table.select("reject", (decision_list.verdict(rules, {n: F.col(n) for n in "abc"}) > 0).alias("hit"))
    tally = {(r["reject"], r["hit"]): r["count"] for r in hit.groupBy("reject", "hit").count().collect()}
    assert tally.get((True, False), 0) <= 15 and tally.get((False, True), 0) <= 5


def test_rules_are_ordered(spark):
    first = decision_list.Rule((decision_list.Condition("a", True, 0.5),))
    second = decision_list.Rule((decision_list.Condition("a", False, 0.7), decision_list.Condition("b", True, 0.0)))
    rows = spark.createDataFrame([(0.6, 1.0), (0.1, 1.0), (0.1, -1.0)], "a double, b double")
    got = [r[0] for r in rows.select(decision_list.verdict([first, second], {"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == [1, 2, 0]


def test_no_labels_and_no_rows(spark, odd_docs, no_docs, labels):
    none = labels.limit(0)
    assert decision_list.learn(odd_docs, none) == []
    assert decision_list.learn(no_docs, labels) == []
    kept = decision_list.keep_good(odd_docs, [])
    assert kept.columns == odd_docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(r["text"] for r in odd_docs.collect() if not counts(r["text"])[5])
    nulls = spark.createDataFrame([(None, 0, 0), (9, None, None)], "doc_id bigint, quality int, toxic int")
    assert decision_list.learn(odd_docs, nulls) == []


def test_no_python_in_the_plan(documents):
    rule = decision_list.Rule((decision_list.Condition("symbols", True, 0.1),))
    plan = decision_list.keep_good(documents, [rule])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_extract_all") == 1
