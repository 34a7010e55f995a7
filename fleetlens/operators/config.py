"""Layered settings, substitution, tags, sizing, security and retention per context.

Contexts are rows with env_name, app_name, region, account_id and account_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions import maps, naming
from fleetlens.settings import Settings


def merge_layers(layers: DataFrame) -> DataFrame:
    """(scope, key, value, priority) to one value per scope and key; the highest priority wins.

    Keys are compared without case. The value of the strongest layer is kept even if null.
    """
    return layers.groupBy("scope", F.lower("key").alias("key")).agg(
        F.max_by("value", "priority").alias("value")
    )


def substitution_values(settings: Settings) -> dict[str, Column]:
    """The seven variables over a resolved context with a version."""
    values = [
        F.col("env_name"),
        F.col("account_type"),
        F.col("version"),
        F.col("region"),
        naming.application_name(F.lit("svc"), F.lit("web")),
        naming.application_name(F.lit("task"), F.lit("web")),
        naming.log_group_name(F.lit(settings.log_service), F.lit("web")),
    ]
    return dict(zip(rules.SUBSTITUTED_VARIABLES, values))


def substitute(df: DataFrame, column: str, values: dict[str, Column]) -> DataFrame:
    """Replace ``${NAME}`` in ``column``; names without a value stay and go to ``unresolved``."""
    text = F.col(column)
    for name, value in values.items():
        text = F.replace(text, F.lit("${" + name + "}"), F.coalesce(value, F.lit("")))
    return df.withColumn(column, text).withColumn(
        "unresolved", F.array_distinct(F.regexp_extract_all(column, F.lit(r"\$\{([^{}]*)\}"), 1))
    )


def merge_tags(contexts: DataFrame, stack_tags: Column | None = None) -> DataFrame:
    """Add ``merged_tags``: environment tags, then the five system tags, then the stack's."""
    commit = F.col("commit")
    system = maps.text_map(
        {
            "Environment": F.col("env_name"),
            "Application": F.col("app_name"),
            "Version": F.coalesce(F.substring(commit, 1, 8), F.lit("local")),
            "DeploymentId": F.col("deployment_id"),
            "DeployedAt": F.date_format("deployed_at", "yyyy-MM-dd"),
        }
    )
    layers = [F.col("tags"), system] + ([] if stack_tags is None else [stack_tags])
    return maps.overlay(contexts, "merged_tags", *layers)


def shared_stack_tags() -> Column:
    """Stack tags of a shared base stack."""
    return maps.text_map(
        {"StackType": "EnvironmentBase", "Shared": "true", "Purpose": "SharedInfrastructure"}
    )


def application_stack_tags() -> Column:
    return maps.text_map({"AccountType": F.col("account_type")})


def effective_settings(environments: DataFrame) -> DataFrame:
    """Add ``settings``: the base flag overlaid with the environment's own rows.

    Environment names are compared without case; an unknown one has no settings (null). The
    overlay is made once per environment on the rule rows, not once per row.
    """
    settings = {}
    for env, key, value in rules.BASE_SETTINGS + rules.ENVIRONMENT_SETTINGS:
        settings.setdefault(env, {})[key] = value
    table = rules.rule_table(environments.sparkSession, "_env string, settings map", list(settings.items()))
    return environments.withColumn("_env", F.lower("env_name")).join(table, "_env", "left").drop("_env")


def settings_to_env(df: DataFrame, column: str = "settings") -> DataFrame:
    """Add ``env_vars``: ``APP_`` and the upper-cased key; of equal keys the last one stays."""
    renamed = F.transform(
        F.map_entries(column),
        lambda e: F.struct(
            F.concat(F.lit("APP_"), F.upper(e["key"])).alias("key"),
            F.coalesce(e["value"], F.lit("")).alias("value"),
        ),
    )
    return maps.map_of_last(df, "env_vars", renamed)


def effective_override(environments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides by exact environment name; without one, no monitoring and seven days."""
    return environments.join(overrides, "env_name", "left").withColumns(
        {
            "enhanced_monitoring": F.coalesce("enhanced_monitoring", F.lit(rules.DEFAULT_MONITORING)),
            "backup_days": F.coalesce("backup_days", F.lit(rules.DEFAULT_BACKUP_DAYS)),
        }
    )


def _derived_sizing(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "cpu_units": (F.col("task_cpu") * 1024).cast("int"),
            "zones": F.when(F.col("high_availability"), 3).when(~F.col("high_availability"), 2),
            "deletion_protection": F.col("high_availability"),
        }
    )


def sizing_policy(contexts: DataFrame) -> DataFrame:
    """The sizing table by exact environment name; unknown environments get the smallest."""
    table = rules.sizing(contexts.sparkSession)
    known = [row[0] for row in rules.SIZING_POLICY]
    keyed = contexts.withColumn(
        "_size",
        F.when(F.col("env_name").isin(known), F.col("env_name")).otherwise(rules.SIZING_FALLBACK),
    )
    joined = keyed.join(table.withColumnRenamed("env_name", "_size"), "_size", "left")
    return _derived_sizing(joined.drop("_size"))


def sizing_effective(contexts: DataFrame) -> DataFrame:
    """What applications get: staging the production row, production the unset defaults.

    Names are compared without case; an unknown environment has no sizing (nulls).
    """
    table = rules.sizing(contexts.sparkSession, effective=True)
    joined = contexts.withColumn("_size", F.lower("env_name")).join(
        table.withColumnRenamed("env_name", "_size"), "_size", "left"
    )
    return _derived_sizing(joined.drop("_size"))


def security_defaults(contexts: DataFrame) -> DataFrame:
    """Production accounts: firewall on, no CIDRs. All others: firewall off, one wide CIDR."""
    production = F.coalesce(F.col("account_type") == "Production", F.lit(False))
    return contexts.withColumns(
        {
            "enable_waf": production,
            "allowed_cidrs": F.when(production, F.expr("cast(array() as array<string>)")).otherwise(
                F.array(F.lit("10.0.0.0/8"))
            ),
        }
    )


def retention(contexts: DataFrame, documented: bool = False) -> DataFrame:
    """One row per context and rule: subject, rule, days. ``documented`` adds the guide's days."""
    by_rule: dict[tuple, list[tuple]] = {}
    for scope, value, subject, rule, days in rules.RETENTION:
        by_rule.setdefault((subject, rule, scope), []).append((value, days))

    def days_of(scope: str, cases: list[tuple]) -> Column:
        picked = F.lit(next(days for value, days in cases if value is None))
        for value, days in cases:
            if value is not None:
                picked = F.when(F.col(scope) == value, F.lit(days)).otherwise(picked)
        return picked

    items = [
        F.struct(F.lit(subject).alias("subject"), F.lit(rule).alias("rule"), days_of(scope, cases).alias("days"))
        for (subject, rule, scope), cases in by_rule.items()
    ]
    if documented:
        days = F.lit(None).cast("int")
        for env, value in rules.DOCUMENTED_LOG_DAYS:
            days = F.when(F.col("env_name") == env, F.lit(value)).otherwise(days)
        items.append(
            F.struct(F.lit("app_logs").alias("subject"), F.lit("guide").alias("rule"), days.alias("days"))
        )
    rows = contexts.select("*", F.explode(F.array(*items)).alias("_r")).select(
        *contexts.columns, "_r.subject", "_r.rule", "_r.days"
    )
    return rows.filter("days IS NOT NULL")


def retention_conflicts(rows: DataFrame) -> DataFrame:
    """Environments and subjects whose rules disagree, with every number of days in use."""
    return (
        rows.select("env_name", "subject", "days")
        .distinct()
        .groupBy("env_name", "subject")
        .agg(F.array_sort(F.collect_list("days")).alias("days"))
        .filter(F.size("days") > 1)
    )


def redirect_urls(contexts: DataFrame, settings: Settings) -> DataFrame:
    """Callback and logout URLs per context: ``purpose``, ``pos``, ``url``, ``is_https``."""
    env = F.lower("env_name")

    def urls(hosts: list[str], paths: list[str]) -> Column:
        return F.array(*[F.lit(host + path) for host in hosts for path in paths])

    def for_purpose(paths: list[str]) -> Column:
        picked = urls(rules.LOCAL_HOSTS, paths)
        for name, prefix, local in rules.REDIRECT_HOSTS:
            hosts = [f"https://{prefix}{settings.web_host}"] + (rules.LOCAL_HOSTS if local else [])
            picked = F.when(env == name, urls(hosts, paths)).otherwise(picked)
        return picked

    lists = F.array(
        F.struct(F.lit("callback").alias("purpose"), for_purpose(rules.CALLBACK_PATHS).alias("urls")),
        F.struct(F.lit("logout").alias("purpose"), for_purpose(rules.LOGOUT_PATHS).alias("urls")),
    )
    listed = contexts.select("*", F.explode(lists).alias("_l"))
    return listed.select(
        *contexts.columns, F.col("_l.purpose").alias("purpose"), F.posexplode("_l.urls").alias("pos", "url")
    ).withColumn("is_https", F.startswith("url", F.lit("https://")))
