"""Files as tables, including documents that are hard to read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.operators import containers, inventory, names
from fleetlens.settings import Settings
from fleetlens.sources import documents, files, findings


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def put(folder, name, text):
    (folder / name).write_text(text if isinstance(text, str) else json.dumps(text))
    return str(folder)


REGISTRY = """{
  // accounts
  "environments": {
    "Development": {"AccountId": "1", "AccountType": "NonProduction", "Region": "us-east-2", "Tags": {"Environment": "Development"},},
    "Staging": {"accountId": "2", "AccountType": "not a type"},
    "Production": {"AccountType": "Production", "Tags": {"a": "x//y"}}, /* no id */
    "Integration": {"AccountId": "3", "Region": "eu-west-1"},
    "Elsewhere": {"AccountId": "4"},
  }
}"""


def test_registry(spark, folder):
    df = documents.read_environments(spark, put(folder, "settings.json", REGISTRY))
    got = {r["env_name"]: (r["account_id"], r["account_type"], r["region"], r["tags"], r["error"]) for r in df.collect()}
    assert got == {
        "Development": ("1", "NonProduction", "us-east-2", {"Environment": "Development"}, None),
        "Staging": ("2", "Production", "us-east-1", {}, None),
        "Production": (None, "Production", "us-east-1", {"a": "x//y"}, "AccountId is required"),
        "Integration": ("3", "NonProduction", "eu-west-1", {}, "Unsupported region 'eu-west-1' in environment 'Integration'"),
        "Elsewhere": ("4", None, "us-east-1", {}, "Unknown environment: Elsewhere"),
    }


def test_registry_keeps_the_spelling_of_data(spark, folder):
    text = '{"ENVIRONMENTS": {"region": {"accountid": 7, "accounttype": "Sandbox", "REGION": "us-west-1", "tags": {"region": "a", "Tags": "b"}}}}'
    (row,) = documents.read_environments(spark, put(folder, "settings.json", text)).collect()
    assert (row["env_name"], row["account_id"], row["account_type"], row["region"]) == ("region", "7", "Sandbox", "us-west-1")
    assert row["tags"] == {"region": "a", "Tags": "b"} and row["error"] is None


def test_registry_without_environments(spark, folder):
    df = documents.read_environments(spark, put(folder, "settings.json", "{ not json"))
    assert [r["error"] for r in df.collect()] == ["no environment found"]


SERVICE = """{
  "VPCNAMEPATTERN": "a // b, ] /* c */",
  "ecsConfiguration": {
    "taskDefinition": [{
      "taskDefinitionName": "main", // first
      "containerDefinitions": [
        {"Name": "web", "Image": "say \\"name\\" :x,}", "mountPoints": [], "PortMappings": [{"ContainerPort": 8080, "Protocol": "tcp"},],
         "Environment": [{"name": "A", "value": "b"}], "healthCheck": {"COMMAND": ["CMD", "http://localhost:8080/x"],},},
      ]
    }]
  }
}"""


def test_service_configs(spark, folder):
    put(folder, "development.json", SERVICE)
    put(folder, "staging.json", {"vpcNamePattern": "x"})
    put(folder, "production.json", "{broken")
    configs = documents.read_service_configs(spark, str(folder))
    got = {r["env_name"]: r for r in configs.collect()}
    assert got["staging"]["error"] == got["production"]["error"] == "Invalid ECS configuration format"
    doc = got["development"]["doc"]
    assert got["development"]["error"] is None and doc["vpcNamePattern"] == "a // b, ] /* c */"
    c = doc["ecsConfiguration"]["taskDefinition"][0]["containerDefinitions"][0]
    assert (c["name"], c["image"], c["portMappings"][0]["containerPort"]) == ("web", 'say "name" :x,}', 8080)
    assert c["environment"][0]["value"] == "b" and c["healthCheck"]["command"] == ["CMD", "http://localhost:8080/x"]
    assert c["secrets"] is None
    missing = documents.missing_service_configs(rules.environments(spark), configs)
    assert [r["env_name"] for r in missing.collect()] == ["Integration"]


def test_equal_configs_do_not_drift(spark, folder):
    put(folder, "development.json", SERVICE)
    put(folder, "production.json", SERVICE)
    rows = containers.explode_containers(documents.read_service_configs(spark, str(folder)))
    flat = rows.select("env_name", "task", "name", "image", F.to_json("portMappings").alias("ports"))
    one, two = (flat.filter(F.col("env_name") == e).drop("env_name") for e in ("development", "production"))
    assert inventory.drift(one, two, ["task", "name"], ["image", "ports"]).count() == 0


POLICY = {
    "Version": "2012-10-17",
    "Statement": [
        {"Sid": "Both", "Effect": "Allow", "Action": ["s3:*", "ec2:*"], "Resource": "*",
         "Condition": {"StringEquals": {"k": "v"}, "StringLike": {"n": ["dev-*", "qa-*"]}}},
        {"Effect": "Allow", "Principal": {"Service": "ecs-tasks.amazonaws.com"}, "Action": "sts:AssumeRole"},
    ],
}


def test_policies(spark, folder):
    put(folder, "wide.json", POLICY)
    put(folder, "single.json", {"Statement": {"Sid": "One", "Effect": "Deny", "Action": "a:b", "Resource": ["x"]}})
    put(folder, "broken.json", "{")
    got = {(r["policy_id"], r["statement_no"]): r for r in documents.read_policies(spark, str(folder)).collect()}
    both, trust = got[("wide", 0)], got[("wide", 1)]
    assert both["actions"] == ["s3:*", "ec2:*"] and both["resources"] == ["*"]
    assert both["action_is_array"] and not both["resource_is_array"]
    assert {(c["op"], c["key"], tuple(c["patterns"])) for c in both["conditions"]} == {
        ("StringEquals", "k", ("v",)), ("StringLike", "n", ("dev-*", "qa-*")),
    }
    assert trust["sid"] is None and trust["resources"] is None and json.loads(trust["principal"]) == {"Service": "ecs-tasks.amazonaws.com"}
    assert got[("single", 0)]["effect"] == "Deny"
    assert got[("broken", None)]["error"] == "document does not parse"


MANIFEST = {
    "stackConfiguration": {
        "applicationName": "AppOne",
        "stacks": [
            {"name": "AlbStack", "id": "alb", "dependsOn": [], "deploymentOrder": 1, "exports": ["alb-arn"]},
            {"name": "EcsStack", "id": "ecs", "dependsOn": ["AlbStack"], "deploymentOrder": 2, "imports": ["alb-arn"]},
        ],
    }
}


def test_manifest(spark, folder):
    parts = documents.read_manifest(spark, put(folder, "stacks.json", MANIFEST))
    rows = {k: [tuple(r)[1:] for r in df.collect()] for k, df in parts.items()}
    assert rows["nodes"] == [("AlbStack", "alb", 1), ("EcsStack", "ecs", 2)]
    assert rows["deps"] == [("EcsStack", "AlbStack")]
    assert rows["exports"] == [("AlbStack", "alb-arn")] and rows["imports"] == [("EcsStack", "alb-arn")]


def test_findings_are_partitioned_and_appended(spark, folder):
    df = spark.createDataFrame([("a", "role"), ("b", "bucket")], "message string, kind string")
    path = str(folder / "findings")
    findings.write_findings(df, path, ["kind"])
    findings.write_findings(df, path, ["kind"])
    assert sorted(p.name for p in (folder / "findings").iterdir() if p.is_dir()) == ["kind=bucket", "kind=role"]
    assert findings.read_findings(spark, path).count() == 4


def test_findings_of_a_hot_value_go_to_several_files(spark, folder):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("kind"))
    path = str(folder / "salted")
    findings.write_findings(df.repartition(16), path, ["kind"], files_per_value=3)
    files = lambda v: len(list((folder / "salted" / f"kind={v}").glob("*.parquet")))
    assert 1 <= files("hot") <= 3 and 1 <= files("cold") <= 3
    assert findings.read_findings(spark, path).select("id", "kind").distinct().count() == 1000


def test_registry_feeds_contexts(spark, folder):
    df = documents.read_environments(spark, put(folder, "settings.json", REGISTRY)).withColumn("app_name", F.lit("AppOne"))
    resolved = names.resolve_context(df.filter("error IS NULL OR error LIKE 'AccountId%'"), Settings())
    assert {r["env_prefix"] for r in resolved.collect()} == {"dev", "stg", "prod"}


def _intake(spark, folder, ledger, number, commit=True, **options):
    changes = files.stage_changes(spark, folder, ledger, number)
    got = {r["name"].rsplit("/", 1)[1]: (r["change"], r["text"], r["file_error"]) for r in files.read_changed(changes, folder, **options).collect()}
    if commit:
        files.commit_changes(spark, ledger, number)
    return got


def test_files_are_read_once(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    (folder / "deep").mkdir(parents=True)
    assert _intake(spark, str(folder), ledger, 0) == {}
    put(folder, "a.json", "﻿{}")
    put(folder, "deep/b.json", "[1,\n2]")
    put(folder, "c.json", " ")
    put(folder, "d.txt", "not asked for")
    put(folder, "empty.json", "")
    first = {"a.json": ("new", "{}", None), "b.json": ("new", "[1,\n2]", None), "c.json": ("new", " ", None)}
    assert _intake(spark, str(folder), ledger, 1, commit=False) == first  # not committed: seen again
    assert _intake(spark, str(folder), ledger, 1) == first
    assert _intake(spark, str(folder), ledger, 2) == {}
    put(folder, "a.json", "{ }")
    put(folder, "c.json", "")  # an empty file counts as gone
    (folder / "e.json").write_bytes(b"\xff\xfe{")
    put(folder, "f.json", "x" * 100)
    os.utime(put(folder, "old.json", "late") + "/old.json", (1_000_000_000, 1_000_000_000))
    second = {
        "a.json": ("changed", "{ }", None), "c.json": ("removed", None, None), "e.json": ("new", None, "file is not UTF-8"),
        "f.json": ("new", None, "file is longer than 50 bytes"), "old.json": ("new", "late", None),
    }
    assert _intake(spark, str(folder), ledger, 3, max_bytes=50) == second
    assert _intake(spark, str(folder), ledger, 3, max_bytes=50) == second  # a run done again sees what it saw
    assert _intake(spark, str(folder), ledger, 4) == {}
    put(folder, "c.json", "back")
    assert _intake(spark, str(folder), ledger, 5) == {"c.json": ("new", "back", None)}


def test_a_file_that_goes_after_the_listing_is_an_error(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    put(folder, "a.json", "1"), put(folder, "b.json", "2")
    changes = files.stage_changes(spark, str(folder), ledger, 1)
    (folder / "a.json").unlink()
    got = {r["name"][-6:]: (r["text"], r["file_error"]) for r in files.read_changed(changes, str(folder)).collect()}
    assert got == {"a.json": (None, "file could not be read"), "b.json": ("2", None)}


def test_of_files_with_one_name_the_newest_counts(spark, tmp_path):
    for i, (name, text) in enumerate([("doc=1/x.json", "old"), ("doc=1/y.json", "new"), ("other.json", "o")]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        put(tmp_path, name, text)
        os.utime(tmp_path / name, (1_000_000_000 + i, 1_000_000_000 + i))
    listed = files.list_files(spark, str(tmp_path), "*.json", r"doc=(\d+)/")
    rows = {r["name"]: r["path"].rsplit("/", 1)[1] for r in listed.collect()}
    assert rows.pop("1") == "y.json" and list(rows.values()) == ["other.json"] and next(iter(rows)).endswith("/other.json")


def test_many_small_files_make_no_more_tasks_than_a_shuffle(spark, folder):
    for i in range(300):
        put(folder, f"f{i}.json", "{}")
    keys = (files._LISTING_TASKS, files._KEPT)
    before = [spark.conf.get(key) for key in keys]
    listed = files.list_files(spark, str(folder))
    assert listed.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions")) and listed.count() == 300
    changes = files.file_changes(listed, files.known_files(spark, str(folder / "none"), 1)).coalesce(1)
    read = files.read_changed(changes, str(folder))
    assert read.rdd.getNumPartitions() > 1 and {r["text"] for r in read.collect()} == {"{}"}
    assert [spark.conf.get(key) for key in keys] == before


def test_documents_are_files_of_one_run_each(spark, folder):
    from fleetlens.plans import fleet_tables

    rows = [("a", 1, "{\n}"), ("a", 1, "{\n}"), ("a", 2, None), ("b", 3, ""), ("b", None, "\u00e9"), ("a", -4, "x")]
    texts = spark.createDataFrame(rows, "shelf string, doc bigint, text string")
    fleet_tables.write_documents(texts, f"{folder}/mine", 1)
    fleet_tables.write_documents(texts, f"{folder}/mine", 1)
    texts.repartition(2, "doc").write.partitionBy("shelf", "doc").text(f"{folder}/sparks")
    contents = lambda top: {(p.parent.relative_to(top), p.read_bytes()) for p in top.rglob("*.txt")}
    assert contents(folder / "mine") == contents(folder / "sparks") and len(contents(folder / "mine")) == 5
    fleet_tables.write_documents(texts.limit(1), f"{folder}/mine", 2)
    assert sum(p.is_file() for p in (folder / "mine").rglob("*")) == 6
    found = files.list_files(spark, f"file://{folder}/mine", "*.txt", r"/doc=(\d+)/").collect()
    assert sorted(r["name"] for r in found if r["name"].isdigit()) == ["1", "2", "3"]
