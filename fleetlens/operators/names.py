"""Name audit: contexts, expected names, limits, collisions and siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions import naming
from fleetlens.functions.text import messages
from fleetlens.session import checkpointed
from fleetlens.settings import Settings


def resolve_context(
    df: DataFrame,
    settings: Settings,
    environments: DataFrame | None = None,
    applications: DataFrame | None = None,
    regions: DataFrame | None = None,
) -> DataFrame:
    """Add prefix, account type, codes and ``errors`` to rows with env_name, app_name, region.

    An unknown name is an error in the row, never a lost row. The three dimensions hold one
    row per name; registered codes come in through the arguments.
    """
    spark = df.sparkSession
    environments = rules.environments(spark) if environments is None else environments
    applications = rules.applications(spark, settings) if applications is None else applications
    regions = rules.regions(spark) if regions is None else regions
    added = ("env_prefix", "account_type", "app_code", "region_code", "errors")
    kept = [c for c in df.columns if c not in added]
    joined = (
        df.select(*kept)
        .join(environments, "env_name", "left")
        .join(applications, "app_name", "left")
        .join(regions, "region", "left")
    )

    def unknown(code: str, label: str, name: str) -> tuple[Column, Column]:
        return F.col(code).isNull(), F.concat(F.lit(f"Unknown {label}: "), F.coalesce(F.col(name), F.lit("")))

    return joined.select(
        *kept,
        "env_prefix",
        "account_type",
        "app_code",
        "region_code",
        messages(
            unknown("env_prefix", "environment", "env_name"),
            unknown("app_code", "application", "app_name"),
            unknown("region_code", "region", "region"),
        ).alias("errors"),
    )


def expected_names(inventory: DataFrame, settings: Settings, name_kinds: DataFrame | None = None) -> DataFrame:
    """Add ``expected_name`` to a resolved inventory with kind, specific, service, type_code.

    ``type_code`` in the inventory is only read for custom kinds; a null ``specific`` takes
    the default purpose of its kind.
    """
    kinds = rules.name_kinds(inventory.sparkSession) if name_kinds is None else name_kinds
    layout = naming.name_layout(settings)
    kinds = kinds.select("kind", "default_purpose", *[c.alias(n) for n, c in layout.items()])
    custom = F.col("type_code") if "type_code" in inventory.columns else None
    joined = inventory.join(kinds, "kind", "left").withColumn("_specific", F.coalesce("specific", "default_purpose"))
    name = naming.name_from_layout(settings, F.col("_specific"), F.col("service"), custom)
    return joined.select(*inventory.columns, name.alias("expected_name"))


def audit_names(inventory: DataFrame, settings: Settings, name_kinds: DataFrame | None = None) -> DataFrame:
    """Expected against observed names, ignoring case; null ``is_valid`` without a context."""
    return expected_names(inventory, settings, name_kinds).withColumn(
        "is_valid", F.lower("observed_name") == F.lower("expected_name")
    )


def name_limit_violations(names: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of (kind, name) that are too long or use characters outside the pattern."""
    checked = names.join(limits, "kind").withColumn(
        "problems",
        messages(
            (
                F.length("name") > F.col("max_length"),
                F.concat(
                    F.lit("too long: "), F.length("name").cast("string"),
                    F.lit(" chars, max "), F.col("max_length").cast("string"),
                ),
            ),
            (~F.rlike("name", F.col("pattern")), "characters not allowed"),
        ),
    )
    return checked.filter(F.size("problems") > 0).drop("max_length", "pattern")


def name_collisions(names: DataFrame) -> DataFrame:
    """Names that several environments of one account type share, ignoring case.

    Rows are reduced to distinct (account type, name, environment) before any name is
    gathered, so the list per name stays as small as the registry even if one name holds
    most of the rows. Nameless rows are left out at the end: a test on the name before the
    aggregation would build every name twice.
    """
    return (
        names.filter("account_type IS NOT NULL")
        .select("account_type", F.lower("name").alias("lower_name"), "env_name")
        .distinct()
        .groupBy("account_type", "lower_name")
        .agg(F.array_sort(F.collect_list("env_name")).alias("environments"), F.count("lower_name").alias("_named"))
        .filter((F.size("environments") > 1) & (F.col("_named") > 0))
        .drop("_named")
    )


def siblings(environments: DataFrame, by: str) -> DataFrame:
    """(by, siblings): the distinct environment names of each account, or account type.

    One row per account; a context finds its own by the key it carries. Rows are never
    paired with each other, and no list is repeated on every context.
    """
    distinct = environments.select(by, "env_name").distinct()
    return distinct.groupBy(by).agg(F.array_sort(F.collect_list("env_name")).alias("siblings"))


def purpose_violations(inventory: DataFrame) -> DataFrame:
    """Rows of (kind, specific) whose purpose is not one of the family that the kind takes.

    Kinds with free text take any, and a kind with a default purpose takes none at all.
    """
    kinds = rules.name_kinds(inventory.sparkSession).filter("family IS NOT NULL").select(
        F.col("kind").alias("_kind"), F.col("family").alias("expected_family"), "default_purpose"
    )
    known = rules.purposes(inventory.sparkSession).select(F.col("family").alias("_family"), F.col("text").alias("_text"))
    return (
        inventory.join(kinds, F.col("kind") == F.col("_kind"))
        .filter(F.col("specific").isNotNull() | F.col("default_purpose").isNull())
        .join(known, (F.col("expected_family") == F.col("_family")) & (F.lower("specific") == F.col("_text")), "left_anti")
        .select(*inventory.columns, "expected_family")
    )


def environments_by_account(environments: DataFrame) -> DataFrame:
    """Environment names per account. A type that is set but does not parse drops the row."""
    account_type = F.coalesce("account_type", F.lit("NonProduction"))
    return (
        environments.select(
            F.coalesce("account_id", F.lit("Unknown")).alias("account_id"),
            account_type.alias("account_type"),
            "env_name",
        )
        .filter(F.col("account_type").isin(rules.ACCOUNT_TYPES))
        .groupBy("account_id", "account_type", "env_name")
        .agg(F.count("*").alias("_n"))
        .groupBy("account_id", "account_type")
        .agg(F.array_sort(F.collect_list("env_name")).alias("environments"), F.sum("_n").alias("n_rows"))
    )


def register_codes(dim: DataFrame, new_rows: DataFrame, key: str, code: str, order: str):
    """Register rows in ``order``; return (dimension, rejects with ``reason``).

    A row is rejected when its key or its code is missing, or taken by the dimension or by an
    earlier accepted row. A row without an order comes last; equal orders go by key, code and
    the other columns, and of rows that are alike in everything the first is taken.

    Each round accepts every row that is first for both its key and its code among those
    still open, the first of all among them, so rounds end; they follow the longest chain of
    conflicts, not the rows. A round is one checkpoint of what it accepts and leaves open.
    """
    columns = dim.columns
    given = new_rows.columns
    missing = F.when(F.col(key).isNull(), "key is missing").when(F.col(code).isNull(), "code is missing")
    usable = new_rows.filter(missing.isNull()).groupBy(*given).agg(F.count("*").cast("int").alias("_n"))
    others = [c for c in given if c not in (order, key, code)]
    place = F.struct(F.col(order).isNull().alias("_last"), order, key, code, *others)
    asked = checkpointed(usable.withColumns({"_place": place, "_id": F.monotonically_increasing_id()}))

    def still_free(rows: DataFrame, taken: DataFrame) -> DataFrame:
        return rows.join(taken.select(key).distinct(), key, "left_anti").join(
            taken.select(code).distinct(), code, "left_anti"
        )

    accepted = asked.limit(0)
    left = still_free(asked, dim)
    while True:
        first_key = left.groupBy(key).agg(F.min("_place").alias("_k"))
        first_code = left.groupBy(code).agg(F.min("_place").alias("_c"))
        firsts = (
            left.join(first_key, key).join(first_code, code)
            .filter((F.col("_place") == F.col("_k")) & (F.col("_place") == F.col("_c")))
            .select(asked.columns)
        )
        rest = still_free(left, firsts).select(asked.columns)
        state = checkpointed(
            firsts.withColumn("_accepted", F.lit(True)).unionByName(rest.withColumn("_accepted", F.lit(False)))
        )
        if state.isEmpty():
            break
        taken, left = state.filter("_accepted").drop("_accepted"), state.filter("NOT _accepted").drop("_accepted")
        if taken.isEmpty():
            raise RuntimeError("a round accepted nothing")
        accepted = accepted.unionByName(taken)
    registered = dim.unionByName(accepted.select(*columns))
    keys = dim.select(F.col(key).alias("_key"), F.lit(None).cast(asked.schema["_place"].dataType).alias("_since")).unionByName(
        accepted.select(F.col(key).alias("_key"), F.col("_place").alias("_since"))
    ).groupBy("_key").agg(F.min("_since").alias("_since"), F.bool_or(F.col("_since").isNull()).alias("_old"))
    earlier = F.coalesce(F.col("_old") | (F.col("_since") < F.col("_place")), F.lit(False))
    mine = F.col("_since") == F.col("_place")
    reason = F.when(earlier | F.coalesce(mine, F.lit(False)), "key already registered").otherwise("code already in use")
    repeats = F.when(F.coalesce(mine & ~F.col("_old"), F.lit(False)), F.col("_n") - 1).otherwise(F.col("_n"))
    rejected = (
        asked.join(keys, F.col(key) == F.col("_key"), "left")
        .select(*given, F.explode_outer(F.array_repeat(reason, repeats)).alias("reason"))
        .filter(F.col("reason").isNotNull())
    )
    unusable = new_rows.withColumn("reason", missing).filter(F.col("reason").isNotNull())
    return registered, rejected.unionByName(unusable)
