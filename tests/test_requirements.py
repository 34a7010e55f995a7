"""Role requirements, their check, tags, endpoints and drift."""

from pyspark.sql import functions as F

from fleetlens import Settings, rules
from fleetlens.functions import naming
from fleetlens.operators import inventory, names, requirements

SETTINGS = Settings(applications=(("AppOne", "tfv2"), ("Cdk", "cdk")))


def required(spark, *envs):
    rows = [(e, "AppOne", "us-east-1", "1") for e in envs]
    df = spark.createDataFrame(rows, "env_name string, app_name string, region string, account_id string")
    return requirements.requirements(names.resolve_context(df, SETTINGS))


def test_production_accounts_need_one_role_more(spark):
    rows = required(spark, "Development", "Staging").collect()
    by_env = {}
    for r in rows:
        by_env.setdefault(r["env_name"], {})[r["purpose"]] = r
    assert sorted(by_env["Development"]) == ["EcsExecution", "EcsTask"]
    assert sorted(by_env["Staging"]) == ["EcsExecution", "EcsTask", "S3Access"]
    task = by_env["Development"]["EcsTask"]
    assert task["expected_arn"] == "arn:aws:iam::1:role/dev-tfv2-role-ue1-ecs-task"
    assert task["expected_tags"] == {"Environment": "Development", "Application": "AppOne", "Purpose": "EcsTask"}
    assert by_env["Staging"]["S3Access"]["expected_tags"] == {}


def test_general_roles_do_not_need_an_account_type(spark):
    rows = required(spark, "Nowhere").collect()
    assert sorted(r["purpose"] for r in rows) == ["EcsExecution", "EcsTask"] and {r["account_type"] for r in rows} == {None}


def roles(spark, *rows):
    return spark.createDataFrame(rows, "account_id string, role_name string, trust_document string, policy_arns array<string>")


TRUST = '{"Service":"ecs-tasks.amazonaws.com"}'


def test_check_roles(spark):
    found = roles(
        spark,
        ("1", "dev-tfv2-role-ue1-ecs-task", TRUST, []),
        ("1", "dev-tfv2-role-ue1-ecs-exec", None, ["arn:x"]),
        ("2", "stg-tfv2-role-ue1-ecs-task", TRUST, []),
    )
    rows = {(r["env_name"], r["purpose"]): r for r in requirements.check_roles(required(spark, "Development", "Staging"), found).collect()}
    task, execution = rows[("Development", "EcsTask")], rows[("Development", "EcsExecution")]
    assert task["is_valid"] and task["warnings"] == ["S3 access validation not fully implemented"]
    assert execution["errors"] == ["Role cannot assume ECS tasks", "Role missing ECS execution policy"]
    assert execution["exists"] and execution["follows_name"] and not execution["has_permissions"]
    twice = requirements.check_roles(required(spark, "Development", "Staging"), found.union(found)).count()
    assert twice == len(rows)
    other_account = rows[("Staging", "EcsTask")]
    assert other_account["errors"] == ["IAM role 'stg-tfv2-role-ue1-ecs-task' does not exist"]
    assert not other_account["exists"] and other_account["warnings"] == []


def test_roles_made_by_the_stack_are_reported_missing(spark):
    base = required(spark, "Development")
    made = base.select("account_id", naming.stack_role_name("task").alias("role_name")).distinct().withColumns(
        {"trust_document": F.lit(TRUST), "policy_arns": F.array(F.lit("x"))}
    )
    assert requirements.check_roles(base, made).filter("exists").count() == 0


def test_unknown_rules_types_and_contexts(spark):
    base = required(spark, "Development", "Nowhere").filter("purpose = 'EcsTask'").union(
        required(spark, "Development").filter("purpose = 'EcsTask'").withColumn("resource_type", F.lit("IamPolicy"))
    ).union(required(spark, "Development").filter("purpose = 'EcsTask'").withColumn("resource_type", F.lit("Vpc")))
    base = base.withColumn("rules", F.array(F.lit("CANASSUMEECSTASKS"), F.lit("Odd")))
    rows = requirements.check_roles(base, roles(spark, ("1", "dev-tfv2-role-ue1-ecs-task", TRUST, [])))
    got = {r["resource_type"]: r for r in rows.filter("env_name = 'Development'").collect()}
    (nowhere,) = rows.filter("env_name = 'Nowhere'").collect()
    assert nowhere["errors"] == ["Error validating resource: Unknown environment: Nowhere"] and not nowhere["is_valid"]
    assert got["IamRole"]["is_valid"] and got["IamRole"]["warnings"] == ["Unknown validation requirement: Odd"]
    assert got["IamPolicy"]["errors"] == ["IAM policy validation not implemented yet"]
    assert got["Vpc"]["errors"] == ["Validation for resource type Vpc not implemented"] and not got["Vpc"]["follows_name"]


def test_summary_adds_up_and_empty_is_valid(spark):
    rows = spark.createDataFrame(
        [("a", True, ["e"], []), ("a", False, [], ["w"]), ("b", True, [], []), ("b", True, ["e"], ["w"])],
        "key string, is_valid boolean, errors array<string>, warnings array<string>",
    )
    got = {r["key"]: r for r in requirements.summarise(rows, ["key"]).collect()}
    assert all(r["valid"] + r["invalid"] == r["total"] for r in got.values())
    assert not got["a"]["all_valid"] and got["b"]["all_valid"]
    messages = requirements.summary_messages(rows.withColumn("res", F.lit("r")), ["key"], "res").collect()
    assert {(r["key"], r["severity"], r["message"], r["n"]) for r in messages} == {
        ("a", "error", "r: e", 1), ("a", "warning", "r: w", 1), ("b", "error", "r: e", 1), ("b", "warning", "r: w", 1),
    }
    assert requirements.all_valid(rows.filter("key = 'none'")).first()[0] is True
    assert requirements.all_valid(rows).first()[0] is False
    assert requirements.all_errors(rows, ["key"]).count() == 2


def test_report_lists_each_role_once(spark):
    df = requirements.requirement_report(required(spark, "Development", "Development", "Staging"))
    rows = df.collect()
    assert len(rows) == 5 and {r["section_lines"] for r in rows} == {5} and {r["section_total"] for r in rows} == {7}
    assert max(r["n_contexts"] for r in rows) == 2


def test_last_result_wins(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 3, None), ("k", 2, "mid")], "key string, seq int, value string")
    assert [tuple(r) for r in requirements.last_results(rows, ["key"], "seq").collect()] == [("k", 3, None)]


def test_tags(spark):
    resources = spark.createDataFrame(
        [(1, "secret", {"Environment": "Development", "Application": "x"}), (2, "secret", {"Environment": "development"}), (3, "role", {})],
        "id int, scope string, tags map<string,string>",
    )
    needed = rules.rule_table(
        spark, "scope string, tag string, expected string", [("secret", "Environment", "Development"), ("secret", "Application", None)]
    )
    got = [tuple(r) for r in inventory.tag_violations(resources, needed, ["id"]).orderBy("id", "tag").collect()]
    assert got == [(2, "Application", None, None, "missing"), (2, "Environment", "Development", "development", "wrong")]


def test_endpoints_look_at_the_first_state_only(spark):
    endpoints = spark.createDataFrame([("a", 2, "available"), ("a", 1, "pending"), ("b", 1, "available")], "service string, pos int, state string")
    needed = spark.createDataFrame([("a",), ("b",), ("c",)], "service string")
    got = {r["service"]: (r["n_endpoints"], r["status"]) for r in inventory.endpoint_availability(endpoints, needed).collect()}
    assert got == {"a": (2, "pending"), "b": (1, "available"), "c": (0, "none")}


def test_drift_and_rule_differences(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, name string, note string")
    right = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "d", "z")], "id int, name string, note string")
    got = sorted((tuple(r) for r in inventory.drift(left, right, ["id"], ["name", "note"]).collect()), key=str)
    assert got == [
        (2, "changed", "name", "b", "B"), (2, "changed", "note", "x", None), (3, "removed", None, None, None), (4, "added", None, None, None),
    ]
    assert inventory.drift(left, left, ["id"], ["name", "note"]).count() == 0
    odd = spark.createDataFrame([(None, "a", None), (None, "a", None), (1, "a", "x"), (1, "b", "y"), (2, "c", "z")], left.schema)
    assert inventory.drift(odd, odd, ["id"], ["name", "note"]).count() == 0
    less = spark.createDataFrame([(None, "a", None), (1, "d", "w"), (2, "c", "z")], left.schema)
    got = sorted((tuple(r) for r in inventory.drift(odd, less, ["id"], ["name", "note"]).collect()), key=str)
    assert got == [(1, "ambiguous", None, "2", "1"), (None, "removed", None, None, None)]
    sg = rules.shared_sg_rules(spark)
    assert inventory.rule_differences(sg, sg, sg.columns).count() == 0
    more = sg.unionByName(sg.filter("sg = 'alb' AND to_port = 80"))
    fewer = sg.filter("sg <> 'vpc-endpoints'")
    assert [(r["sg"], r["side"], r["n"]) for r in inventory.rule_differences(sg, more, sg.columns).collect()] == [("alb", "unexpected", 1)]
    assert [(r["sg"], r["side"], r["n"]) for r in inventory.rule_differences(sg, fewer, sg.columns).collect()] == [("vpc-endpoints", "missing", 1)]


def test_existence(spark):
    needed = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    have = spark.createDataFrame([("a", None), ("b", "key"), ("b", None)], "name string, kms_key_id string")
    got = {r["name"]: (r["present"], r["kms_key_id"]) for r in inventory.existence(needed, have, ["name"]).collect()}
    assert got == {"a": (True, "default"), "b": (True, "key"), "c": (False, None)}
