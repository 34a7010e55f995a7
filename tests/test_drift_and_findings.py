"""Drift by ranges and of documents, findings that may be written again, summaries by levels, counts as a stream."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import inventory, requirements, traffic
from fleetlens.sources import findings
from fleetlens.streaming import drift as stream_drift


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_ranges_find_the_same_drift(spark):
    rnd = random.Random(2)
    schema = "id bigint, name string, note string"
    left = [(rnd.choice([None, rnd.randrange(3000)]) if i % 50 == 0 else i, rnd.choice("abc"), rnd.choice(["x", None])) for i in range(3000)]
    right = [(i, n, m) if not 1200 <= (i or 0) < 1230 else (i, "changed", m) for i, n, m in left if i != 77] + [(9000, "new", None)]
    one, two = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    levels = [F.floor(F.col("id") / 500), F.floor(F.col("id") / 20)]
    found = inventory.drift_by_ranges(one, two, ["id"], ["name", "note"], levels)
    assert rows(found) == rows(inventory.drift(one, two, ["id"], ["name", "note"])) and found.count() >= 30
    assert inventory.drift_by_ranges(one, one, ["id"], ["name", "note"], levels).count() == 0
    assert inventory.drift_by_ranges(one.limit(0), one.limit(0), ["id"], ["name", "note"], levels).count() == 0


def test_one_per_cent_of_drift_moves_about_one_per_cent_of_the_rows(spark):
    one = spark.range(20_000).selectExpr("id", "concat('v', id) AS name")
    two = one.withColumn("name", F.when(F.col("id").between(5000, 5199), "other").otherwise(F.col("name")))
    ranges = inventory.differing_ranges(one, two, ["id", "name"], [F.floor(F.col("id") / 1000), F.floor(F.col("id") / 25)])
    assert [r.count() for r in ranges] == [1, 8]
    finest = {r["_range_1"] for r in ranges[1].collect()}
    assert sum(1 for i in range(20_000) if i // 25 in finest) == 200


def test_rows_repeated_many_times_are_not_one_list(spark, monkeypatch):
    monkeypatch.setattr(inventory, "STEP", 7)
    many = spark.range(100).selectExpr("CAST(NULL AS int) AS id", "'a' AS name")
    some = spark.range(14).selectExpr("1 AS id", "'b' AS name")
    found = inventory.drift(many.union(some), many.limit(0), ["id"], ["name"])
    assert rows(found) == Counter({(None, "removed", None, None, None): 100, (1, "removed", None, None, None): 14})


def documents(spark, texts):
    return spark.createDataFrame(texts, "id int, text string").select("id", F.try_parse_json("text").alias("doc"))


def leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return [leaf for k, v in value.items() for leaf in leaves(v, path + "." + k.lower().replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\["))]
    if isinstance(value, list) and value:
        return [leaf for i, v in enumerate(value) for leaf in leaves(v, f"{path}[{i}]")]
    import json

    return [(path, value if isinstance(value, str) else json.dumps(value, separators=(",", ":")))]


def test_document_values_by_brute_force(spark):
    import json

    rnd = random.Random(4)

    def made(depth):
        kind = rnd.randrange(6 if depth else 3)
        if kind >= 4:
            return {rnd.choice(["a", "B", "c.d", "e[0]", "f\\"]) + str(i): made(depth - 1) for i in range(rnd.randrange(4))}
        if kind == 3:
            return [made(depth - 1) for _ in range(rnd.randrange(4))]
        return rnd.choice([None, True, False, 7, -3, "text", "", "é"])

    docs = {i: made(5) for i in range(60)}
    frame = documents(spark, [(i, json.dumps(d)) for i, d in docs.items()] + [(-1, None), (-2, "{broken")])
    got = rows(inventory.document_values(frame, ["id"], "doc"))
    assert got == Counter((i, *leaf) for i, d in docs.items() for leaf in leaves(d))


def test_equal_documents_of_other_spelling_do_not_drift(spark):
    one = documents(spark, [(1, '{"A":{"b":[1,2.50,"x"],"c":null},"D":{}}'), (2, '{"deep":{"a":{"b":1}}}')])
    two = documents(spark, [(1, ' {"d" : {}, "a":{"C":null, "B":[1, 2.5, "x"]}}'), (2, '{"deep":{"a":{"b":2}}}')])
    assert rows(inventory.document_drift(one, two, ["id"], "doc")) == Counter({(2, "$.deep.a.b", "changed", "1", "2"): 1})
    cut = inventory.document_drift(one, two, ["id"], "doc", depth=1).filter("id = 2")
    assert rows(cut) == Counter({(2, "$.deep", "changed", '{"a":{"b":1}}', '{"a":{"b":2}}'): 1})
    assert inventory.document_drift(one, one, ["id"], "doc").count() == 0


def test_a_run_written_again_is_there_once(spark, tmp_path):
    path = str(tmp_path / "findings")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, kind string")
    findings.write_run(first, path, "monday", ["kind"])
    findings.write_run(first.filter("id = 1"), path, "tuesday", ["kind"])
    findings.write_run(first.filter("kind = 'b'"), path, "monday", ["kind"])
    read = findings.read_findings(spark, path)
    assert rows(read.select("id", "kind", "run")) == Counter({(2, "b", "monday"): 1, (3, "b", "monday"): 1, (1, "a", "tuesday"): 1})
    assert len(list((tmp_path / "findings" / "run=monday" / "kind=b").glob("*.parquet"))) == 1
    plan = read.filter("run = 'monday'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan
    with pytest.raises(ValueError):
        findings.write_run(first, path, "../other")


def test_a_stream_that_starts_again_counts_every_row_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, env_id int, is_drift boolean"
    times = [["2024-01-05 01:00:00", None], ["2024-01-01 02:00:00", "2024-01-05 03:00:00", None], []]
    for part in times:
        if part:
            spark.createDataFrame([(t, 1, True) for t in part] + [(part[0], 2, False)], "t string, env_id int, is_drift boolean").select(
                F.to_timestamp("t").alias("ts"), "env_id", "is_drift"
            ).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_drift.start_drift_counts(stream, out, state).awaitTermination()
    batch = stream_drift.drift_windows(spark.read.schema(schema).parquet(source))
    assert rows(stream_drift.read_drift_counts(spark, out)) == rows(batch)
    assert {r["n"] for r in batch.collect()} == {1, 2}


def test_levels_do_not_mix_with_null_keys(spark):
    results = spark.createDataFrame(
        [("a", None, True), ("a", "x", False), (None, "x", True), ("a", None, None)], "account string, env string, is_valid boolean"
    )
    found = requirements.summarise(results, ["account", "env"], [["account", "env"], ["account"], []])
    got = {(r["level"], r["account"], r["env"]): (r["total"], r["valid"], r["invalid"], r["no_context"]) for r in found.collect()}
    assert got == {
        ("account,env", "a", None): (2, 1, 0, 1), ("account,env", "a", "x"): (1, 0, 1, 0), ("account,env", None, "x"): (1, 1, 0, 0),
        ("account", "a", None): (3, 1, 1, 1), ("account", None, None): (1, 1, 0, 0), ("", None, None): (4, 2, 1, 1),
    }


def test_the_order_of_listings_does_not_matter(spark):
    required = spark.createDataFrame(
        [(1, "IamRole", "r", ["HasEcsExecutionPolicy", "CanAssumeEcsTasks"])], "account_id int, resource_type string, expected_name string, rules array<string>"
    )
    good, other = "arn:aws:iam::aws:policy/service-role/AmazonECSTaskExecutionRolePolicy", "arn:zz"
    schema = "account_id int, role_name string, trust_document string, policy_arns array<string>"
    listings = [(1, "r", "ecs-tasks.amazonaws.com", [other]), (1, "r", None, [good]), (1, "r", "zz", None)]
    for order in (listings, listings[::-1]):
        [row] = requirements.check_roles(required, spark.createDataFrame(order, schema)).collect()
        assert row["is_valid"] and row["errors"] == []
    [row] = requirements.check_roles(required, spark.createDataFrame(listings[:1], schema)).collect()
    assert row["errors"] == ["Role missing ECS execution policy"]


def test_a_queue_without_a_limit_is_an_error(spark):
    receives = spark.createDataFrame([("q", "m", 0), (None, "m", 1), ("known", "m", 2)], "queue string, message_id string, s int").withColumn("ts", F.timestamp_seconds("s"))
    limits = spark.createDataFrame([("known", 1)], "queue string, max_receives int")
    got = {(r["queue"], r["expires_on"], r["error"]) for r in traffic.dead_letters(receives, limits, "1970-02-01").collect()}
    assert got == {("q", None, "queue without a limit: q"), (None, None, "queue without a limit: none")}
