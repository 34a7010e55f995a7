"""Settings, tags, sizing and retention."""

import datetime

from pyspark.sql import functions as F

from fleetlens import Settings, rules
from fleetlens.functions import maps
from fleetlens.operators import config, names

SETTINGS = Settings(applications=(("AppOne", "tfv2"), ("Cdk", "cdk")))
COLUMNS = "env_name string, app_name string, region string, account_id string, account_type string"


def contexts(spark, *envs):
    types = {e: t for e, _, t in rules.ENVIRONMENTS}
    rows = [(e, "AppOne", "us-east-2", "1", types.get(e, "Sandbox")) for e in envs]
    return spark.createDataFrame(rows, COLUMNS)


def test_layers_last_one_wins_without_case(spark):
    layers = spark.createDataFrame(
        [("s", "Key", "base", 1), ("s", "key", "env", 2), ("s", "KEY", None, 3), ("s", "other", "x", 1), ("t", "key", "y", 1)],
        "scope string, key string, value string, priority int",
    )
    got = {(r["scope"], r["key"]): r["value"] for r in config.merge_layers(layers).collect()}
    assert got == {("s", "key"): None, ("s", "other"): "x", ("t", "key"): "y"}


def test_substitution(spark):
    df = names.resolve_context(contexts(spark, "Development").drop("account_type"), SETTINGS).withColumns(
        {"version": F.lit("1.2"), "text": F.lit("${ENVIRONMENT} ${TASK_DEFINITION_FAMILY} ${ALB_SECURITY_GROUP_ID} ${environment}")}
    )
    row = config.substitute(df, "text", config.substitution_values(SETTINGS)).first()
    assert row["text"] == "Development dev-tfv2-task-ue2-web ${ALB_SECURITY_GROUP_ID} ${environment}"
    assert row["unresolved"] == ["ALB_SECURITY_GROUP_ID", "environment"]


def test_system_tags_win_over_environment_tags(spark):
    df = contexts(spark, "Development").withColumns(
        {
            "tags": maps.text_map({"Environment": "OverrideValue", "Own": "kept"}),
            "commit": F.lit("0123456789abcdef"),
            "deployment_id": F.lit("d1"),
            "deployed_at": F.lit(datetime.datetime(2023, 12, 25, 14, 30, 45)),
        }
    )
    tags = config.merge_tags(df, config.application_stack_tags()).first()["merged_tags"]
    assert tags == {
        "Environment": "Development", "Application": "AppOne", "Version": "01234567", "DeploymentId": "d1",
        "DeployedAt": "2023-12-25", "Own": "kept", "AccountType": "NonProduction",
    }
    without = config.merge_tags(df.withColumns({"commit": F.lit(None).cast("string"), "tags": F.lit(None).cast("map<string,string>")}))
    assert without.first()["merged_tags"]["Version"] == "local"


def test_settings_ignore_case_and_integration_has_only_the_base_flag(spark):
    df = config.effective_settings(contexts(spark, "INTEGRATION", "production", "Sandbox"))
    got = {r["env_name"]: r["settings"] for r in df.collect()}
    assert got["INTEGRATION"] == {"EnableDetailedLogging": "True"}
    assert got["production"]["EnableDetailedLogging"] == "False" and len(got["production"]) == 7
    assert got["Sandbox"] is None


def test_settings_to_env_keeps_the_last_of_equal_keys(spark):
    df = spark.range(1).withColumn("settings", maps.text_map({"ab": "1", "aB": "2", "c": "3"}))
    assert config.settings_to_env(df).first()["env_vars"] == {"APP_AB": "2", "APP_C": "3"}


def test_override_defaults_by_exact_name(spark):
    df = config.effective_override(contexts(spark, "Development", "Staging", "Production", "staging"), rules.overrides(spark))
    assert {r["env_name"]: (r["enhanced_monitoring"], r["backup_days"]) for r in df.collect()} == {
        "Development": (False, 1), "Staging": (True, 7), "Production": (True, 30), "staging": (False, 7),
    }


def test_sizing_policy_and_effective_sizing_differ(spark):
    base = contexts(spark, "Development", "Staging", "Production", "Nowhere")
    policy = {r["env_name"]: r for r in config.sizing_policy(base).collect()}
    effective = {r["env_name"]: r for r in config.sizing_effective(base).collect()}
    assert policy["Development"]["cpu_units"] == 512 and policy["Nowhere"]["instance_type"] == "t3.small"
    assert policy["Staging"]["instance_type"] == "t3.medium" and policy["Production"]["zones"] == 3
    assert effective["Staging"]["instance_type"] == "t3.large"
    assert effective["Production"]["instance_type"] == "t3.micro" and effective["Production"]["zones"] == 2
    assert effective["Nowhere"]["instance_type"] is None


def test_security(spark):
    got = {r["env_name"]: (r["enable_waf"], r["allowed_cidrs"]) for r in config.security_defaults(contexts(spark, "Production", "Development")).collect()}
    assert got == {"Production": (True, []), "Development": (False, ["10.0.0.0/8"])}


def test_retention_conflicts(spark):
    rows = config.retention(contexts(spark, "Development", "Integration", "Staging", "Production"))
    found = {(r["env_name"], r["subject"]): r["days"] for r in config.retention_conflicts(rows).collect()}
    assert found == {("Integration", "backups"): [1, 7]}
    sandbox = {r["subject"]: r["days"] for r in config.retention(contexts(spark, "Sandbox")).filter("rule <> 'override'").collect()}
    assert sandbox["app_logs"] == 3 and sandbox["shared_logs"] == 7


def test_redirect_urls_are_all_https(spark):
    df = config.redirect_urls(contexts(spark, "Production", "Integration", "Sandbox"), SETTINGS)
    assert df.filter("NOT is_https").count() == 0
    counts = {(r["env_name"], r["purpose"]): r["count"] for r in df.groupBy("env_name", "purpose").count().collect()}
    assert counts == {
        ("Production", "callback"): 1, ("Production", "logout"): 2, ("Integration", "callback"): 3,
        ("Integration", "logout"): 6, ("Sandbox", "callback"): 2, ("Sandbox", "logout"): 4,
    }


def test_overlay_needs_no_session_setting(spark):
    layers = maps.text_map({"a": "1", "b": "1"}), F.lit(None).cast("map<string,string>"), maps.text_map({"b": "2"})
    assert maps.overlay(spark.range(1), "m", *layers).first()["m"] == {"a": "1", "b": "2"}
