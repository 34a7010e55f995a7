"""Names and registry rules with the results the convention prescribes."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens import Settings, rules
from fleetlens.functions import naming
from fleetlens.operators import names
from fleetlens.plans import audits

SETTINGS = Settings(applications=(("AppOne", "tfv2"), ("Cdk", "cdk")))


def context(spark, env, region="us-east-1", app="AppOne"):
    df = spark.createDataFrame([(env, app, region)], "env_name string, app_name string, region string")
    return names.resolve_context(df, SETTINGS)


def one(df, column):
    return df.select(column.alias("c")).first()[0]


@pytest.mark.parametrize(
    "type_code, specific, region, env, expected",
    [
        ("ecs", "main", "us-east-1", "Development", "dev-tfv2-ecs-ue1-main"),
        ("ecs", "main", "us-west-2", "Production", "prod-tfv2-ecs-uw2-main"),
        ("vpc", "main", "us-east-2", "Integration", "int-tfv2-vpc-ue2-main"),
        ("vpc", "isolated", "us-east-2", "Integration", "int-tfv2-vpc-ue2-isolated"),
        ("VPC", "", "us-east-2", "Staging", "stg-tfv2-vpc-ue2"),
        ("vpc", None, "us-east-2", "Staging", "stg-tfv2-vpc-ue2"),
    ],
)
def test_application_name(spark, type_code, specific, region, env, expected):
    df = context(spark, env, region)
    assert one(df, naming.application_name(F.lit(type_code), F.lit(specific))) == expected


def test_other_templates(spark):
    dev = context(spark, "Development")
    assert one(dev, naming.security_group_name(F.lit("alb"), F.lit("web"))) == "dev-tfv2-sg-alb-web-ue1"
    integration = context(spark, "Integration")
    assert one(integration, naming.bucket_name(SETTINGS, F.lit("app"))) == "example.io-int-tfv2-app-ue1"
    prod = context(spark, "Production")
    assert one(prod, naming.log_group_name(F.lit("ECS"), F.lit("Web-App"))) == "/aws/ecs/prod-tfv2-web-app"
    assert one(prod, naming.shared_log_group_name(F.lit("shared"), F.lit("main"))) == "/aws/shared/prod-shared-main"
    assert one(prod, naming.shared_name(F.lit("vpc"), F.lit("main"))) == "prod-shared-vpc-ue1-main"
    assert one(prod, naming.image_repository_name(SETTINGS, F.lit("Web"))) == "example/appone/Web"
    assert one(prod, naming.stack_name(F.lit("ECS"))) == "prod-tfv2-ecs-ue1"
    assert one(prod, naming.stack_name(F.lit("unheard-of"))) is None


@pytest.mark.parametrize(
    "env, app, region, error",
    [
        ("Nowhere", "AppOne", "us-east-1", ["Unknown environment: Nowhere"]),
        ("development", "AppOne", "us-east-1", ["Unknown environment: development"]),
        ("Development", "Other", "us-east-1", ["Unknown application: Other"]),
        ("Development", "AppOne", "eu-west-1", ["Unknown region: eu-west-1"]),
        ("Development", "AppOne", "us-east-1", []),
    ],
)
def test_unknown_context_is_an_error_row(spark, env, app, region, error):
    assert context(spark, env, region, app).first()["errors"] == error


def test_every_name_kind_yields_a_name(spark):
    df = context(spark, "Staging").crossJoin(rules.name_kinds(spark).select("kind")).withColumns(
        {"specific": F.lit("main"), "service": F.lit("ecs"), "type_code": F.lit("tg")}
    )
    got = {r["kind"]: r["expected_name"] for r in names.expected_names(df, SETTINGS).collect()}
    assert len(got) == 43 and all(got.values())
    assert got["custom"] == "stg-tfv2-tg-ue1-main"
    assert got["sg_rds"] == "stg-tfv2-sg-rds-main-ue1"


@pytest.mark.parametrize(
    "kind, specific, observed, valid",
    [
        ("application_load_balancer", "web", "prod-tfv2-alb-ue2-web", True),
        ("application_load_balancer", "web", "PROD-tfv2-ALB-ue2-web", True),
        ("application_load_balancer", "web", "prd-tfv2-alb-ue2-web", False),
        ("bucket", "app", "example.io-prod-tfv2-app-ue2", True),
        ("bucket", "app", "prod-tfv2-alb-logs-ue2-web", False),
        ("unheard-of", "app", "prod-tfv2-app-ue2", None),
    ],
)
def test_audit(spark, kind, specific, observed, valid):
    df = context(spark, "Production", "us-east-2").withColumns(
        {"kind": F.lit(kind), "specific": F.lit(specific), "service": F.lit(None).cast("string"), "observed_name": F.lit(observed)}
    )
    assert names.audit_names(df, SETTINGS).first()["is_valid"] is valid
    assert audits.name_findings(df, SETTINGS, ["kind"]).count() == (1 if valid is False else 0)


def test_default_purpose(spark):
    df = context(spark, "Staging").withColumns(
        {"kind": F.lit("sg_bastion"), "specific": F.lit(None).cast("string"), "service": F.lit(None).cast("string")}
    )
    assert names.expected_names(df, SETTINGS).first()["expected_name"] == "stg-tfv2-sg-bastion-admin-ue1"


def test_convention_never_collides(spark):
    envs = rules.environments(spark).withColumns({"app_name": F.lit("AppOne"), "region": F.lit("us-east-1")})
    resolved = names.resolve_context(envs, SETTINGS)
    built = resolved.withColumn("name", naming.application_name(F.lit("ecs"), F.lit("main")))
    assert names.name_collisions(built).count() == 0


def test_siblings_by_type_and_by_id_differ(spark):
    envs = spark.createDataFrame(
        [("Development", "NonProduction", "1"), ("Integration", "NonProduction", "1"), ("Staging", "Production", "2"), ("Production", "Production", "3")],
        "env_name string, account_type string, account_id string",
    )
    by_type = {r["account_type"]: r["siblings"] for r in names.siblings(envs, "account_type").collect()}
    by_id = {r["account_id"]: r["siblings"] for r in names.siblings(envs, "account_id").collect()}
    assert by_type["NonProduction"] == by_id["1"] == ["Development", "Integration"]
    assert by_type["Production"] == ["Production", "Staging"] and by_id["2"] == ["Staging"] and len(by_id) == 3


def test_purposes_belong_to_a_family(spark):
    rows = spark.createDataFrame(
        [("rds_instance", "primary"), ("rds_instance", "uploads"), ("bucket", "uploads"), ("role", None), ("vpc", None), ("ecs_task_named", "x"), ("queue", "DLQ")],
        "kind string, specific string",
    )
    found = {(r["kind"], r["specific"], r["expected_family"]) for r in names.purpose_violations(rows).collect()}
    assert found == {("rds_instance", "uploads", "resource"), ("role", None, "iam")}


def test_limits_name_length_and_characters(spark):
    rows = spark.createDataFrame(
        [("bucket", "a" * 63), ("bucket", "a" * 64), ("bucket", "Up_per"), ("ecs_cluster", "a" * 255), ("auth_domain", "a" * 64)],
        "kind string, name string",
    )
    found = names.name_limit_violations(rows, rules.name_limits(spark)).collect()
    assert sorted((r["kind"], len(r["name"]), r["problems"][0].split(":")[0]) for r in found) == [
        ("auth_domain", 64, "too long"), ("bucket", 6, "characters not allowed"), ("bucket", 64, "too long"),
    ]


def greedy(dim, rows):
    keys, codes, out = {k for k, _ in dim}, {c for _, c in dim}, {}
    for seq, key, code in sorted(rows):
        if key in keys:
            out[seq] = "key already registered"
        elif code in codes:
            out[seq] = "code already in use"
        else:
            out[seq] = "ok"
            keys.add(key)
            codes.add(code)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_register_codes_follows_the_order_of_requests(spark, seed):
    rnd = random.Random(seed)
    dim = [("k0", "c0"), ("k1", "c1")]
    rows = [(i, f"k{rnd.randrange(12)}", f"c{rnd.randrange(12)}") for i in range(30)]
    dim_df = spark.createDataFrame(dim, "key string, code string")
    new_df = spark.createDataFrame(rows, "seq int, key string, code string")
    registered, rejects = names.register_codes(dim_df, new_df, "key", "code", "seq")
    want = greedy(dim, rows)
    assert {r["seq"]: r["reason"] for r in rejects.collect()} == {s: w for s, w in want.items() if w != "ok"}
    accepted = {(k, c) for s, k, c in rows if want[s] == "ok"} | set(dim)
    assert {tuple(r) for r in registered.collect()} == accepted


def test_register_codes_ends_on_missing_equal_and_repeated_rows(spark):
    dim = spark.createDataFrame([("k0", "c0")], "key string, code string")
    rows = [
        (1, None, "c1"), (2, "k2", None), (3, "k3", "c3"), (3, "k3", "c3"), (3, "k3", "c4"), (3, "k4", "c4"), (None, "k5", "c4"),
        (None, "k6", "c6"), (None, "k6", "c6"), (4, "k0", "c9"), (4, "k9", "c0"), (4, "k9", "c0"),
    ]
    new = spark.createDataFrame(rows, "seq int, key string, code string")
    registered, rejects = names.register_codes(dim, new, "key", "code", "seq")
    assert sorted(tuple(r) for r in registered.collect()) == [("k0", "c0"), ("k3", "c3"), ("k4", "c4"), ("k6", "c6")]
    got = sorted((r["seq"] or 0, r["key"] or "", r["code"] or "", r["reason"]) for r in rejects.collect())
    used, taken = "code already in use", "key already registered"
    assert got == [
        (0, "k5", "c4", used), (0, "k6", "c6", taken), (1, "", "c1", "key is missing"), (2, "k2", "", "code is missing"), (3, "k3", "c3", taken),
        (3, "k3", "c4", taken), (4, "k0", "c9", taken), (4, "k9", "c0", used), (4, "k9", "c0", used),
    ]
