import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import boosted, toxicity
from fleetlens.llm.labels import held_out, labelled_sample


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_folds_and_bounded_sample(spark, documents, labels):
    rows = labels.select("doc_id", held_out(labels["doc_id"]).alias("out")).collect()
    assert all(r["out"] == is_held_out(r["doc_id"]) for r in rows)
    chosen = labelled_sample(documents, labels, "quality", 30, "doc_id", "text").collect()
    assert len(chosen) == 30 and not any(is_held_out(r["doc_id"]) for r in chosen)


def test_a_labelled_id_of_many_rows_counts_once(spark):
    rows = [(1, f"text {i:03}") for i in range(400)] + [(1, None), (3, None), (None, "n")] + [(i, f"t{i}") for i in range(4, 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, None), (None, 1)] + [(i, 1) for i in range(5, 20)], "doc_id bigint, quality int")
    found = {r["doc_id"]: (r["text"], r["label"]) for r in labelled_sample(docs, labels, "quality", 100, "doc_id", "text").collect()}
    want = {1: ("text 000", 0), 3: (None, 1), **{i: (f"t{i}", 1) for i in range(5, 20)}}
    assert found == {i: v for i, v in want.items() if not is_held_out(i)}
    assert labelled_sample(docs, labels, "quality", 2, "doc_id", "text").count() == 2


def test_statistics_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["", None, "To To To of of.\nTo To\nTo To", "AB 12 *** é!?\n\nx", "a" * 50, "one\x1ctwo three"]
    whole = boosted.statistics(pa.array(texts))
    alone = np.concatenate([boosted.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(whole, alone)
    row = dict(zip(boosted.STATISTICS, whole[2]))
    assert row["words"] == pytest.approx(math.log(10)) and row["distinct"] == pytest.approx(3 / 9)
    assert row["most_frequent"] == pytest.approx(7 / 9) and row["repeated_lines"] == pytest.approx(1 / 3)
    assert not whole[0].any() and not whole[1].any()


def test_forest_learns_an_interaction_and_scores_as_its_trees_do():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.3)).astype(float)
    forest = boosted.fit(x[:2000], y[:2000], trees=30, depth=3)
    score = forest.score(x[2000:])
    assert ((score > 0.5) == y[2000:]).mean() > 0.95
    for i in range(20):
        margin = forest.base
        for t in range(30):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(x[2000 + i, forest.feature[t, node]] >= forest.threshold[t, node])
            margin += forest.leaf[t, node - 7]
        assert score[i] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_quality_held_out_accuracy(documents, labels):
    found = boosted.score(documents, boosted.train(documents, labels)).join(labels, "doc_id").collect()
    assert found
    right = [(r["score"] >= 0.7) == r["quality"] for r in found if is_held_out(r["doc_id"])]
    assert np.mean(right) >= 0.85


@pytest.mark.parametrize("operator", [boosted, toxicity])
def test_odd_texts_and_no_labels(spark, odd_docs, no_docs, labels, operator):
    model = operator.train(odd_docs, labels.limit(0))
    rows = operator.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] == 0.5 for r in rows)
    assert operator.score(no_docs, operator.train(no_docs, labels)).count() == 0
    marked = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 15)] + [(None, 1, 1), (3, None, None)], labels.schema)
    rows = operator.score(odd_docs, operator.train(odd_docs, marked)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_swaps():
    groups = (("women", "men"),)
    assert toxicity.swapped("Women and men, womenfolk", groups) == ["men and women, womenfolk", " and , womenfolk"]
    assert toxicity.swapped("nobody", groups) == [] and toxicity.swapped("women", ()) == []


def test_counterfactuals_clear_neutral_mentions(spark):
    """Group mentions go with toxic words in training; alone they must not raise the score."""
    draw = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(60)]

    def text(*extra):
        return " ".join([*draw.choice(plain, 12), *extra])

    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        group = ["muslim"] if draw.random() < (0.9 if toxic else 0.05) else []
        rows.append((i, text(*group, *(["scum"] if toxic and draw.random() < 0.8 else [])), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    probes = pa.array([text("muslim"), text("christian"), text(), text("scum")])
    fair = toxicity.train(docs, labels, fairness=10.0).score(probes)
    unfair = toxicity.train(docs, labels, fairness=0.0).score(probes)
    assert unfair[0] >= 0.3 > fair[0]  # the threshold of the query
    assert abs(fair[0] - fair[2]) < 0.1 and fair[3] > 0.5


def test_toxicity_held_out(documents, labels):
    model = toxicity.train(documents, labels)
    found = toxicity.score(documents, model).join(labels, "doc_id").collect()
    clean = [r["score"] < 0.3 for r in found if not r["toxic"] and is_held_out(r["doc_id"])]
    assert np.mean(clean) >= 0.95
    learnt = [r["score"] >= 0.3 for r in found if r["toxic"] and not is_held_out(r["doc_id"])]
    assert np.mean(learnt) >= 0.5


def test_toxic_words_are_found_in_new_texts(spark):
    rows = [(i, f"a{i % 37} b{i % 11} " + ("awfulzzz" + str(i % 5) if i % 5 == 0 else "fine"), int(i % 5 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    score = toxicity.train(docs, labels).score(pa.array(["new words awfulzzz9 here", "new words here", "", None]))
    assert score[0] > 0.5 and (score[1:] < 0.3).all()
