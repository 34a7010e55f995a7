import pytest

import corpus_pipeline
from fleetlens.llm import catalog, decision_list, mixing
from fleetlens.plans.check import compare, database

from .conftest import LOWER, WORD
from .test_decision_list import counts
from .test_trie_join import brute, shingle_set


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), [spark.read.parquet(f"{small}/documents.parquet").toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.toPandas())
    return out


def test_stages_and_their_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "jaccard_dedup", "mixing", "packing"]
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:-1])


def test_quality_rules_reject_at_least_the_base_failures(spark, small, stages):
    docs, kept = stages[0], set(stages[1]["doc_id"])
    passed = {d for d, t in zip(docs["doc_id"], docs["text"]) if not counts(t)[5]}
    assert kept <= passed
    rules = decision_list.learn(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    assert rules or kept == passed


def test_exact_dedup(stages):
    before, after = stages[1], stages[2]
    best = {}
    for d, t in zip(before["doc_id"], before["text"]):
        best[t.translate(LOWER)] = max(d, best.get(t.translate(LOWER), d))
    assert sorted(after["doc_id"]) == sorted(best.values())


def test_near_dedup(stages):
    rows = list(zip(stages[2]["doc_id"].tolist(), stages[2]["text"]))
    expected = {c for _, n, c in brute(rows)}
    assert sorted(stages[3]["doc_id"]) == sorted(expected)
    assert all(shingle_set(t) for t in stages[3]["text"])


def test_mixing(stages):
    before, after = stages[3], stages[4]
    size = {d: len(WORD.findall(t)) for d, t in zip(before["doc_id"], before["text"])}
    copies = after["doc_id"].value_counts()
    assert set(copies.index) <= set(size) and copies.max() <= mixing.CAP
    assert abs(sum(size[d] * n for d, n in copies.items()) - sum(size.values())) <= sum(size.values()) * 0.15


def test_packing(stages):
    mixed, packed = stages[4], stages[5]
    assert sorted(packed[packed["piece"] == 0]["doc_id"]) == sorted(mixed["doc_id"])
    for _, rows in packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (rows["offset"].to_numpy() == rows["length"].cumsum().shift(fill_value=0).to_numpy()).all()
        assert rows["length"].sum() <= 4096
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 4096) + 1


def test_run_gives_the_rows_of_the_stages(spark, small, stages):
    found = corpus_pipeline.run(spark, small).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found[key].to_numpy())) == sorted(map(tuple, stages[5][key].to_numpy()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_against_sql(spark, small, name):
    assert compare(catalog.QUERIES[name](spark, small), database(small), catalog.ORACLES[name]) == []


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
