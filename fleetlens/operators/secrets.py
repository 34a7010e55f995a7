"""Secret names, the distinct secrets of a document and the import-or-create plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import rules


def secret_name(variable: Column) -> Column:
    return F.lower(F.replace(variable, F.lit("__"), F.lit("-")))


def is_identity_secret(name: Column) -> Column:
    return F.lower(name).isin(rules.IDENTITY_SECRETS)


def distinct_secrets(containers: DataFrame, doc_keys: list[str], first_task: Column | None = None) -> DataFrame:
    """Distinct secrets per document, plus the constant one, from its first task only.

    Exploding the containers' own lists with the constant appended keeps this to one
    aggregation.
    """
    listed = F.coalesce(F.col("secrets"), F.expr("cast(array() as array<string>)"))
    if first_task is not None:
        listed = F.when(first_task, listed).otherwise(F.expr("cast(array() as array<string>)"))
    return (
        containers.select(*doc_keys, F.explode(F.concat(listed, F.array(F.lit(rules.CONSTANT_SECRET)))).alias("secret"))
        .filter("secret IS NOT NULL")
        .distinct()
    )


def secret_plan(requested: DataFrame, existing: DataFrame, order: str | None = None) -> DataFrame:
    """(path, variable) requests to one row per path: import what exists, create the rest.

    ``existing`` has ``path`` and an optional ``lookup_ok``; a failed lookup counts as
    missing. Several variables that collapse to one path are a collision; the one that was
    asked for first by ``order`` is served, or the first by name without one. A path's variables are spellings of one name, so the
    set stays small however often the path is requested.
    """
    found = existing
    if "lookup_ok" in existing.columns:
        found = existing.filter(F.coalesce("lookup_ok", F.lit(False)))
    found = found.select("path").distinct().withColumn("_found", F.lit(True))
    place = F.lit(0) if order is None else F.col(order)
    per_path = (
        requested.groupBy("path", "variable")
        .agg(F.count("*").alias("_n"), F.min(place).alias("_place"))
        .groupBy("path")
        .agg(
            F.array_sort(F.collect_list("variable")).alias("variables"), F.sum("_n").alias("n_requests"),
            F.min(F.struct(F.col("_place").isNull().alias("_late"), "_place", "variable")).alias("_first"),
        )
    )
    return per_path.join(found, "path", "left").select(
        "path",
        F.when(F.col("_found"), "import").otherwise("create").alias("action"),
        F.col("_first.variable").alias("served_variable"),
        "variables",
        "n_requests",
        (F.size("variables") > 1).alias("is_collision"),
    )
