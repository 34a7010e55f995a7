"""Required roles, their check against an inventory, and summaries of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions import maps, naming


_ITEM = "array<struct<resource_type:string,purpose:string,purpose_text:string,rules:array<string>,tagged:boolean>>"


def requirements(contexts: DataFrame, requirement_rules: DataFrame | None = None) -> DataFrame:
    """The roles each resolved context needs, with expected name, ARN, rules and tags.

    Rules without account types hold for every context, also for one whose account type is
    unknown; the others are listed per account type first. Rules are a handful, so a
    context carries its list and is never paired with rules it does not need.
    """
    table = rules.role_requirements(contexts.sparkSession) if requirement_rules is None else requirement_rules
    listed = F.array_sort(F.collect_list(F.struct("resource_type", "purpose", "purpose_text", "rules", "tagged")))
    general = table.filter("account_types IS NULL").agg(listed).scalar()
    by_type = (
        table.filter("account_types IS NOT NULL")
        .withColumn("_type", F.explode("account_types"))
        .groupBy("_type")
        .agg(listed.alias("_typed"))
    )
    needed = F.concat(general, F.coalesce("_typed", F.expr(f"cast(array() AS {_ITEM})")))
    name = naming.application_name(F.lit("role"), "purpose_text")
    return (
        contexts.join(by_type, F.col("account_type") == F.col("_type"), "left")
        .select(*contexts.columns, F.explode_outer(needed).alias("_r"))
        .filter(F.col("_r").isNotNull())
        .select(*contexts.columns, "_r.*")
        .withColumn("expected_name", name)
        .withColumns(
            {
                "expected_arn": naming.arn(F.lit("iam"), F.lit("role"), "expected_name"),
                "expected_tags": F.when(
                    F.col("tagged"),
                    maps.text_map(
                        {
                            "Environment": F.col("env_name"),
                            "Application": F.col("app_name"),
                            "Purpose": F.col("purpose"),
                        }
                    ),
                ).otherwise(maps.empty_map()),
            }
        )
        .drop("tagged", "purpose_text")
    )


def default_checks() -> dict[str, tuple[Column, str]]:
    """Rule id (lower case) to the condition a role must meet and the error otherwise."""
    return {
        "canassumeecstasks": (
            F.coalesce(F.contains("trust_document", F.lit(rules.TASK_SERVICE)), F.lit(False)),
            "Role cannot assume ECS tasks",
        ),
        "hasecsexecutionpolicy": (
            F.coalesce(
                F.exists("policy_arns", lambda a: F.contains(a, F.lit(rules.EXECUTION_POLICY))), F.lit(False)
            ),
            "Role missing ECS execution policy",
        ),
    }


# rules that are known but only ever warn
WARN_ONLY = {"hass3access": "S3 access validation not fully implemented"}


def check_roles(required: DataFrame, roles: DataFrame, checks: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Requirements left-joined to roles (account_id, role_name, trust_document, policy_arns).

    Of a role that is listed more than once, every listing is checked, and one that passes is enough.
    Adds exists, follows_name, has_permissions, errors, warnings and is_valid. An unknown
    rule gives a warning; a type other than a role is an error, and so is a requirement
    whose context has no name (its own ``errors`` say why).
    """
    checks = default_checks() if checks is None else checks
    passed = {rule_id: f"_passed_{i}" for i, rule_id in enumerate(checks)}
    inventory = roles.groupBy("account_id", F.col("role_name").alias("expected_name")).agg(
        *[F.coalesce(F.bool_or(holds), F.lit(False)).alias(passed[rule_id]) for rule_id, (holds, _) in checks.items()],
        F.lit(True).alias("_found"),
    )
    joined = required.join(inventory, ["account_id", "expected_name"], "left").withColumn(
        "_found", F.coalesce("_found", F.lit(False)) & (F.col("resource_type") == "IamRole")
    )

    def error_of(rule: Column) -> Column:
        text = F.lit(None).cast("string")
        for rule_id, (_, message) in checks.items():
            text = F.when((F.lower(rule) == rule_id) & ~F.col(passed[rule_id]), message).otherwise(text)
        return text

    def warning_of(rule: Column) -> Column:
        text = F.when(
            ~F.lower(rule).isin(list(checks)), F.concat(F.lit("Unknown validation requirement: "), rule)
        )
        for rule_id, message in WARN_ONLY.items():
            text = F.when(F.lower(rule) == rule_id, message).otherwise(text)
        return text

    kind = F.col("resource_type")
    unresolved = F.col("errors") if "errors" in required.columns else F.array(F.lit("no expected name"))
    none = F.expr("cast(array() as array<string>)")
    errors = (
        F.when(kind == "IamPolicy", F.array(F.lit("IAM policy validation not implemented yet")))
        .when(
            kind != "IamRole",
            F.array(F.concat(F.lit("Validation for resource type "), kind, F.lit(" not implemented"))),
        )
        .when(F.col("expected_name").isNull(), F.transform(unresolved, lambda e: F.concat(F.lit("Error validating resource: "), e)))
        .when(
            ~F.col("_found"),
            F.array(F.concat(F.lit("IAM role '"), F.col("expected_name"), F.lit("' does not exist"))),
        )
        .otherwise(F.array_compact(F.transform("rules", error_of)))
    )
    warnings = F.when(F.col("_found"), F.array_compact(F.transform("rules", warning_of))).otherwise(none)
    return (
        joined.withColumns({"errors": errors, "warnings": warnings})
        .withColumns(
            {
                "exists": F.col("_found"),
                "follows_name": (kind == "IamRole") & F.col("expected_name").isNotNull(),
                "has_permissions": F.col("_found") & (F.size("errors") == 0),
            }
        )
        .withColumn("is_valid", F.col("exists") & F.col("follows_name") & F.col("has_permissions"))
        .drop("_found", *passed.values())
    )


def last_results(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row per key; ``max_by`` combines before the shuffle."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def summarise(results: DataFrame, keys: list[str], levels: list[list[str]] | None = None) -> DataFrame:
    """Counts per key. A null ``is_valid`` counts as a resource without context, not as invalid.

    With ``levels``, lists of some of the keys, there is a row for each group of every level, and
    ``level`` names its keys, joined by commas: keys outside the level are null there, which a
    null key inside it is not mixed up with. The empty list is the total. Messages are not
    collected into the row; ``summary_messages`` lists them as rows, so one key may hold any
    share of the results.
    """
    present = set(results.columns)
    flag = lambda name, test: (
        F.count_if(test) if name in present else F.lit(None).cast("bigint")
    )
    counts = [
        F.count("*").alias("total"),
        F.count_if(F.col("is_valid")).alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if(F.col("is_valid").isNull()).alias("no_context"),
        flag("exists", ~F.col("exists") if "exists" in present else None).alias("missing"),
        flag("follows_name", ~F.col("follows_name") if "follows_name" in present else None).alias("bad_names"),
        (F.count_if(~F.coalesce("is_valid", F.lit(False))) == 0).alias("all_valid"),
    ]
    if levels is None:
        return results.groupBy(*keys).agg(*counts)
    # one bit for each key that a row's level lacks, the first key having the highest
    lacks = {",".join(level): sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in level) for level in levels}
    grouped = results.groupingSets([[F.col(k) for k in level] for level in levels], *[F.col(k) for k in keys])
    name = F.coalesce(*[F.when(F.col("_lacks") == bits, F.lit(said)) for said, bits in lacks.items()])
    return grouped.agg(F.grouping_id(*keys).alias("_lacks"), *counts).withColumn("level", name).drop("_lacks")


def summary_messages(results: DataFrame, keys: list[str], resource: str) -> DataFrame:
    """Distinct messages per key, prefixed with their resource, and how often each occurs."""
    tagged = F.concat(
        F.transform("errors", lambda m: F.struct(F.lit("error").alias("severity"), m.alias("text"))),
        F.transform("warnings", lambda m: F.struct(F.lit("warning").alias("severity"), m.alias("text"))),
    )
    return (
        results.select(*keys, F.col(resource).alias("_resource"), F.explode(tagged).alias("_m"))
        .groupBy(*keys, F.col("_m.severity").alias("severity"), F.concat_ws(": ", "_resource", "_m.text").alias("message"))
        .agg(F.count("*").alias("n"))
    )


def all_valid(results: DataFrame) -> DataFrame:
    """One row: whether every result is valid. True over an empty set."""
    return results.agg(F.coalesce(F.bool_and("is_valid"), F.lit(True)).alias("all_valid"))


def all_errors(results: DataFrame, keys: list[str]) -> DataFrame:
    """Every error of every result as a row."""
    return results.select(*keys, F.explode_outer("errors").alias("error")).filter(F.col("error").isNotNull())


def requirement_report(required: DataFrame) -> DataFrame:
    """One line per resource of a type, with the size of its section.

    Sections are counted and joined on rather than collected into one row per type.
    """
    lines = required.groupBy(
        "resource_type",
        "expected_name",
        "expected_arn",
        F.array_join("rules", ",").alias("rules"),
        maps.map_text(F.col("expected_tags")).alias("tags"),
    ).agg(F.count("*").alias("n_contexts"))
    sections = lines.groupBy("resource_type").agg(
        F.count("*").alias("section_lines"), F.sum("n_contexts").alias("section_total")
    )
    return lines.join(sections, "resource_type")
