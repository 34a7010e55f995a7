"""JSON documents as tables: registries, service configurations, policies and manifests.

Each reader is a whole-text scan followed by a parser that also works on any text column.
Documents that cannot be read become rows with an error, never a lost row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import rules

SERVICE_SCHEMA = """struct<
  vpcNamePattern:string,
  ecsConfiguration:struct<serviceName:string,taskDefinition:array<struct<
    taskDefinitionName:string,
    containerDefinitions:array<struct<
      name:string,image:string,cpu:int,essential:boolean,
      portMappings:array<struct<containerPort:int,hostPort:int,protocol:string,appProtocol:string>>,
      environment:array<struct<name:string,value:string>>,
      secrets:array<string>,
      healthCheck:struct<command:array<string>,interval:int,timeout:int,retries:int,startPeriod:int,disabled:boolean>,
      disableHealthCheck:boolean>>>>>>"""

MANIFEST_SCHEMA = (
    "struct<stackConfiguration:struct<applicationName:string,stacks:array<struct<"
    "name:string,id:string,dependsOn:array<string>,deploymentOrder:int,"
    "exports:array<string>,imports:array<string>>>>>"
)

_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
#: All up to a trailing comma or the end: strings, a quote that opens none, and commas that something follows.
_TO_COMMA = r'((?:[^",]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|"|,(?!\s*[\]}]))*+)(?:,|\z)'


def relaxed_json(df: DataFrame, text: str) -> DataFrame:
    """Make hand-written JSON in ``text`` readable: drop comments and trailing commas.

    Strings are matched first, so they stay as they are. Texts that need neither are told
    apart by a search. Each step is a projection of its own, so that no rewritten text is
    computed twice.
    """
    c = F.col(text)
    return df.withColumn(
        text,
        F.when(
            F.contains(c, F.lit("//")) | F.contains(c, F.lit("/*")),
            F.regexp_replace(c, _STRING + r"|//[^\r\n]*|/\*(?s:.*?)\*/", "$1"),
        ).otherwise(c),
    ).withColumn(
        text,
        F.when(c.rlike(r",\s*[\]}]"), F.regexp_replace(c, _TO_COMMA, "$1")).otherwise(c),
    )


def _entries(value: Column) -> Column:
    """The members of a JSON object as lists (k, v), keys in lower case and the last first; null if it is no object."""
    members = F.array(F.try_variant_get(value, "$", "map<string,variant>"))
    lists = F.transform(
        members,
        lambda m: F.when(
            m.isNotNull(), F.struct(F.reverse(F.transform(F.map_keys(m), F.lower)).alias("k"), F.reverse(F.map_values(m)).alias("v"))
        ),
    )
    return F.get(lists, F.lit(0))


def _member(entries: Column, name: str) -> Column:
    """The member called ``name`` in any case, the last of several."""
    return F.get(entries["v"], F.array_position(entries["k"], name.lower()).cast("int") - 1)


def _value(entries: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(_member(entries, name), "$", kind)


def _objects(entries: Column, name: str) -> Column:
    """The members of every object of a list."""
    return F.transform(_value(entries, name, "array<variant>"), _entries)


def _bound(fields: dict[str, str], entries: Column, **nested: Column) -> Column:
    """A struct of members, bound without regard to case; null for what is no object."""
    columns = [nested[n].alias(n) if n in nested else _value(entries, n, kind).alias(n) for n, kind in fields.items()]
    return F.when(entries.isNotNull(), F.struct(*columns))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


# --- environment registry ----------------------------------------------------------------


def parse_environments(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per environment of each registry document.

    Members are bound without regard to case, level by level, after one parse; the names of
    environments and tags are data and stay as they are written.
    The region defaults; an account type that does not parse falls back to the one the
    environment's name implies. A missing account id, a type that nothing implies and a
    region without a code are errors, of which the first is given.
    """
    kept = [c for c in df.columns if c != text]
    parsed = (
        relaxed_json(df, text)
        .select(*kept, F.try_parse_json(text).alias("_v"))
        .select(*kept, _entries(F.col("_v")).alias("_top"))
        .select(*kept, F.explode_outer(_value(F.col("_top"), "Environments", "map<string,variant>")).alias("env_name", "_value"))
        .withColumn("_e", _entries(F.col("_value")))
        .select(
            *kept, "env_name",
            F.struct(
                *[_value(F.col("_e"), n).alias(n) for n in ("AccountId", "AccountType", "Region")],
                _value(F.col("_e"), "Tags", "map<string,string>").alias("Tags"),
            ).alias("_e"),
        )
    )
    implied = rules.environments(df.sparkSession).select("env_name", F.col("account_type").alias("_implied"))
    given = F.col("_e.AccountType")
    account_type = F.when(given.isin(rules.ACCOUNT_TYPES), given).otherwise(F.col("_implied"))
    region = F.coalesce("_e.Region", F.when(F.col("env_name").isNotNull(), F.lit(rules.DEFAULT_REGION)))
    return parsed.join(implied, "env_name", "left").select(
        *kept,
        "env_name",
        F.col("_e.AccountId").alias("account_id"),
        account_type.alias("account_type"),
        region.alias("region"),
        F.coalesce("_e.Tags", F.expr("cast(map() as map<string,string>)")).alias("tags"),
        F.when(F.col("env_name").isNull(), "no environment found")
        .when(F.col("_e.AccountId").isNull(), "AccountId is required")
        .when(account_type.isNull(), F.concat(F.lit("Unknown environment: "), "env_name"))
        .when(
            ~region.isin([r for r, _ in rules.REGIONS]),
            F.concat(F.lit("Unsupported region '"), region, F.lit("' in environment '"), "env_name", F.lit("'")),
        )
        .alias("error"),
    )


def read_environments(spark: SparkSession, path: str) -> DataFrame:
    return parse_environments(read_texts(spark, path))


# --- service configuration ---------------------------------------------------------------


_PORT = {"containerPort": "int", "hostPort": "int", "protocol": "string", "appProtocol": "string"}
_VARIABLE = {"name": "string", "value": "string"}
_HEALTH = {
    "command": "array<string>", "interval": "int", "timeout": "int", "retries": "int", "startPeriod": "int", "disabled": "boolean",
}
_CONTAINER = {
    "name": "string", "image": "string", "cpu": "int", "essential": "boolean", "portMappings": "", "environment": "",
    "secrets": "array<string>", "healthCheck": "", "disableHealthCheck": "boolean",
}


def _container(entries: Column) -> Column:
    return _bound(
        _CONTAINER, entries,
        portMappings=F.transform(_objects(entries, "portMappings"), lambda e: _bound(_PORT, e)),
        environment=F.transform(_objects(entries, "environment"), lambda e: _bound(_VARIABLE, e)),
        healthCheck=F.transform(F.array(_entries(_member(entries, "healthCheck"))), lambda e: _bound(_HEALTH, e))[0],
    )


def _task(entries: Column) -> Column:
    return _bound(
        {"taskDefinitionName": "string", "containerDefinitions": ""}, entries,
        containerDefinitions=F.transform(_objects(entries, "containerDefinitions"), _container),
    )


def parse_service_configs(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``doc`` and ``error``; the text column is dropped.

    A text is parsed once, however many rows hold it, and its document joined to all of them by
    the text; a hash of it leads the key, so that rows are sorted by numbers. Rows of a stream are
    parsed one by one. Members are bound without regard to case, level by level.
    """
    kept = [c for c in df.columns if c != text]
    if df.isStreaming:
        parsed = _parsed_services(df, text)
    else:
        different = df.select(F.col(text).alias("_text")).distinct()
        docs = _parsed_services(different.withColumns({"_hash": F.xxhash64("_text"), "_json": F.col("_text")}), "_json")
        same = (F.xxhash64(text) == F.col("_hash")) & (F.col(text) == F.col("_text"))
        parsed = df.join(docs, same, "left")
    return parsed.select(
        *kept, "doc", F.when(F.col("doc.ecsConfiguration").isNull(), "Invalid ECS configuration format").alias("error")
    )


def _parsed_services(df: DataFrame, text: str) -> DataFrame:
    """``doc`` in place of the text of each row."""
    kept = [c for c in df.columns if c != text]
    service = _bound(
        {"serviceName": "string", "taskDefinition": ""}, F.col("_ecs"),
        taskDefinition=F.transform(_objects(F.col("_ecs"), "taskDefinition"), _task),
    )
    doc = _bound({"vpcNamePattern": "string", "ecsConfiguration": ""}, F.col("_top"), ecsConfiguration=service)
    return (
        relaxed_json(df, text)
        .select(*kept, F.try_parse_json(text).alias("_v"))
        .select(*kept, _entries(F.col("_v")).alias("_top"))
        .withColumn("_ecs", _entries(_member(F.col("_top"), "ecsConfiguration")))
        .select(*kept, doc.cast(SERVICE_SCHEMA).alias("doc"))
    )


def read_service_configs(spark: SparkSession, path: str) -> DataFrame:
    """Documents named after their lower-cased environment."""
    texts = read_texts(spark, path).withColumn(
        "env_name", F.lower(F.regexp_extract("path", r"([^/]+)\.json$", 1))
    )
    return parse_service_configs(texts)


def missing_service_configs(environments: DataFrame, configs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Environments without a document; with ``keys``, without one of the same keys."""
    keys = keys or []
    found = configs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lower("env_name").alias("_file_env")).distinct()
    same = F.lower("env_name") == F.col("_file_env")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return environments.join(found, same, "left_anti")


# --- policies ----------------------------------------------------------------------------


def _strings(source: str, field: str) -> Column:
    """A string or an array of strings as an array; null when the field is absent."""
    one = f"try_variant_get({source}, '$.{field}', 'string')"
    return F.expr(
        f"coalesce(try_variant_get({source}, '$.{field}', 'array<string>'), "
        f"CASE WHEN {one} IS NOT NULL THEN array({one}) END)"
    )


def parse_policies(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per statement; scalar and array forms of every field are unified.

    ``not_actions`` and ``not_resources`` hold what the statement is not about.
    ``conditions`` is an array of (op, key, patterns). ``action_is_array`` tells the form
    the document used. A document that does not parse has an ``error``.
    """
    kept = [c for c in df.columns if c != text]
    parsed = df.select(*kept, F.try_parse_json(text).alias("_v"))
    statements = parsed.select(
        *kept,
        F.when(F.col("_v").isNull(), "document does not parse").alias("error"),
        F.expr(
            "posexplode_outer(coalesce(try_variant_get(_v, '$.Statement', 'array<variant>'), "
            "filter(array(try_variant_get(_v, '$.Statement', 'variant')), x -> x IS NOT NULL)))"
        ).alias("statement_no", "_s"),
    )
    conditions = F.expr(
        """flatten(transform(
             map_entries(try_variant_get(_s, '$.Condition', 'map<string,map<string,variant>>')),
             o -> transform(map_entries(o.value), k -> struct(
               o.key AS op, k.key AS key,
               coalesce(try_variant_get(k.value, '$', 'array<string>'),
                        array(try_variant_get(k.value, '$', 'string'))) AS patterns))))"""
    )
    return statements.select(
        *kept,
        "error",
        "statement_no",
        F.expr("try_variant_get(_s, '$.Sid', 'string')").alias("sid"),
        F.expr("try_variant_get(_s, '$.Effect', 'string')").alias("effect"),
        _strings("_s", "Action").alias("actions"),
        F.expr("try_variant_get(_s, '$.Action', 'array<string>') IS NOT NULL").alias("action_is_array"),
        _strings("_s", "Resource").alias("resources"),
        F.expr("try_variant_get(_s, '$.Resource', 'array<string>') IS NOT NULL").alias("resource_is_array"),
        _strings("_s", "NotAction").alias("not_actions"),
        _strings("_s", "NotResource").alias("not_resources"),
        F.expr("to_json(try_variant_get(_s, '$.Principal', 'variant'))").alias("principal"),
        conditions.alias("conditions"),
    )


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    texts = read_texts(spark, path).withColumn("policy_id", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    return parse_policies(texts)


# --- stack manifest ----------------------------------------------------------------------


def parse_manifest(df: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """``nodes``, ``deps``, ``exports`` and ``imports`` of each manifest."""
    kept = [c for c in df.columns if c != text]
    stacks = relaxed_json(df, text).select(
        *kept, F.explode_outer(F.from_json(text, MANIFEST_SCHEMA)["stackConfiguration"]["stacks"]).alias("_s")
    )

    def edges(field: str, name: str) -> DataFrame:
        return stacks.select(*kept, F.col("_s.name").alias("stack"), F.explode(f"_s.{field}").alias(name))

    return {
        "nodes": stacks.select(
            *kept, F.col("_s.name").alias("stack"), F.col("_s.id").alias("stack_id"),
            F.col("_s.deploymentOrder").alias("declared_order"),
        ),
        "deps": edges("dependsOn", "depends_on"),
        "exports": edges("exports", "name"),
        "imports": edges("imports", "name"),
    }


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_manifest(read_texts(spark, path))
