"""Service documents and their containers.

A document row has ``doc`` of type ``sources.documents.SERVICE_SCHEMA``. A container row has
the container's own fields as columns. Null and empty lists mean different things and are
kept apart throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions import maps
from fleetlens.functions.text import is_blank, is_empty

CONTAINER_FIELDS = [
    "name", "image", "cpu", "essential", "portMappings", "environment", "secrets",
    "healthCheck", "disableHealthCheck",
]


def explode_tasks(docs: DataFrame) -> DataFrame:
    """One row per task definition; a document without tasks keeps a row of nulls."""
    kept = [c for c in docs.columns if c != "doc"]
    return docs.select(*kept, F.posexplode_outer("doc.ecsConfiguration.taskDefinition").alias("task_no", "_t")).select(
        *kept,
        "task_no",
        F.col("_t.taskDefinitionName").alias("task"),
        F.col("_t.containerDefinitions").alias("containers"),
    )


def explode_containers(docs: DataFrame) -> DataFrame:
    """One row per container with its position in its task."""
    tasks = explode_tasks(docs)
    kept = [c for c in tasks.columns if c != "containers"]
    return tasks.select(*kept, F.posexplode_outer("containers").alias("pos", "_c")).select(
        *kept, "pos", *[F.col(f"_c.{f}").alias(f) for f in CONTAINER_FIELDS]
    )


def explode_ports(containers: DataFrame, keep: list[str]) -> DataFrame:
    return containers.select(*keep, F.posexplode_outer("portMappings").alias("port_no", "_p")).select(
        *keep, "port_no", "_p.containerPort", "_p.hostPort", "_p.protocol", "_p.appProtocol"
    )


def explode_environment(containers: DataFrame, keep: list[str]) -> DataFrame:
    return containers.select(*keep, F.posexplode_outer("environment").alias("var_no", "_e")).select(
        *keep, "var_no", F.col("_e.name").alias("var"), F.col("_e.value").alias("value")
    )


def explode_secrets(containers: DataFrame, keep: list[str]) -> DataFrame:
    return containers.select(*keep, F.posexplode_outer("secrets").alias("secret_no", "secret"))


def _violation(rank: int, rule: str, text: Column | str) -> Column:
    return F.struct(
        F.lit(rank).alias("rank"), F.lit(rule).alias("rule"),
        (F.lit(text) if isinstance(text, str) else text).alias("message"),
    )


def _port_violations(name: Column, port: Column) -> Column:
    head = F.concat(F.lit("Container '"), F.coalesce(name, F.lit("")), F.lit("' has invalid port mapping: "))
    number, protocol = port["containerPort"], port["protocol"]
    missing = F.coalesce(number <= 0, F.lit(True))
    blank = is_blank(protocol)
    return F.array_compact(
        F.array(
            F.when(missing, _violation(0, "port_positive", F.concat(head, F.lit("ContainerPort must be a positive integer")))),
            F.when(number > 65535, _violation(1, "port_range", F.concat(head, F.lit("ContainerPort must be <= 65535")))),
            F.when(blank, _violation(2, "protocol_required", F.concat(head, F.lit("Protocol is required")))),
            F.when(
                ~blank & ~protocol.isin(rules.VALID_PROTOCOLS),
                _violation(
                    3, "protocol_known",
                    F.concat(head, F.lit("Protocol must be 'tcp' or 'udp', got '"), protocol, F.lit("'")),
                ),
            ),
        )
    )


def _container_violations(c: Column) -> Column:
    """All violations of one container in the order in which they are checked."""
    name = c["name"]
    own = F.array_compact(
        F.array(
            F.when(is_blank(name), _violation(0, "name_required", "Container name is required")),
            F.when(
                is_blank(c["image"]),
                _violation(1, "image_required", F.concat(F.lit("Container '"), F.coalesce(name, F.lit("")), F.lit("' requires an image"))),
            ),
        )
    )
    ports = F.coalesce(F.flatten(F.transform(c["portMappings"], lambda p: _port_violations(name, p))), F.array())
    return F.concat(own, ports)


def container_violations(docs: DataFrame) -> DataFrame:
    """Every violation of a document; ``first`` marks the one a strict check would stop at.

    Documents are checked in list order, task by task and container by container. The whole
    check is one expression per document, so it needs no shuffle.
    """
    tasks = F.col("doc.ecsConfiguration.taskDefinition")

    def located(v: Column, task_no: Column, pos: Column) -> Column:
        return F.struct(
            task_no.cast("int").alias("task_no"), pos.cast("int").alias("pos"), v["rule"].alias("rule"),
            v["message"].alias("message"),
        )

    def of_task(t: Column, task_no: Column) -> Column:
        name = F.when(
            is_blank(t["taskDefinitionName"]),
            F.array(_violation(0, "task_name_required", "TaskDefinitionName is required in the configuration")),
        ).otherwise(F.array())
        head = F.transform(name, lambda v: located(v, task_no, F.lit(None)))
        rest = F.transform(
            t["containerDefinitions"],
            lambda c, pos: F.transform(_container_violations(c), lambda v: located(v, task_no, pos)),
        )
        return F.concat(head, F.coalesce(F.flatten(rest), F.array()))

    empty = F.coalesce(F.size(tasks) == 0, F.lit(True))
    none = F.array(
        located(
            _violation(0, "task_required", "At least one TaskDefinition configuration is required"),
            F.lit(None), F.lit(None),
        )
    )
    found = F.when(empty, none).otherwise(F.flatten(F.transform(tasks, of_task)))
    kept = [c for c in docs.columns if c != "doc"]
    return docs.select(*kept, F.posexplode(found).alias("_n", "_v")).select(
        *kept, "_v.*", (F.col("_n") == 0).alias("first")
    )


def duplicate_names(containers: DataFrame, task_keys: list[str]) -> DataFrame:
    """Names used more than once within one task; case counts, blank names do not."""
    return (
        containers.filter(~is_blank(F.col("name")))
        .groupBy(*task_keys, "name")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def container_port(ports: Column) -> Column:
    """8080 if mapped, else the port of the first mapping, else null."""
    preferred = F.exists(ports, lambda p: F.coalesce(p["containerPort"] == rules.PREFERRED_PORT, F.lit(False)))
    return F.when(preferred, F.lit(rules.PREFERRED_PORT)).otherwise(
        F.try_element_at(ports, F.lit(1))["containerPort"]
    )


def primary_container(containers: DataFrame, task_keys: list[str], order: list[str]) -> DataFrame:
    """Per task the first container in list order with a port, else the first one with port 0.

    A task whose only row has no container at all (null ``name`` and ``pos`` as left by
    ``explode_containers``) gets the default container.
    """
    position = F.struct(*order)
    own = F.struct("name", container_port(F.col("portMappings")).alias("port"))
    ported = own["port"].isNotNull()
    picked = containers.groupBy(*task_keys).agg(
        F.min_by(F.when(ported, own), F.when(ported, position)).alias("_ported"),
        F.min_by(own, position).alias("_first"),
    )
    nameless = F.col("_first.name").isNull() & F.col("_ported").isNull()
    return picked.select(
        *task_keys,
        F.when(nameless, F.lit(rules.DEFAULT_CONTAINER))
        .otherwise(F.coalesce("_ported.name", "_first.name"))
        .alias("primary_name"),
        F.when(nameless, F.lit(rules.PREFERRED_PORT))
        .otherwise(F.coalesce("_ported.port", F.lit(0)))
        .alias("primary_port"),
    )


def normalised_ports(name: Column, ports: Column) -> Column:
    """Mappings with a port and a protocol, with a generated name and application protocol."""
    whole = F.filter(ports, lambda p: p["containerPort"].isNotNull() & ~is_blank(p["protocol"]))
    return F.transform(
        F.coalesce(whole, F.array()),
        lambda p: F.struct(
            F.concat_ws("-", name, p["containerPort"].cast("string"), F.lower(p["protocol"])).alias("name"),
            p["containerPort"].alias("container_port"),
            p["hostPort"].alias("host_port"),
            F.lower(p["protocol"]).alias("protocol"),
            F.when(F.lower(p["appProtocol"]) == "grpc", "grpc").otherwise("http").alias("app_protocol"),
        ),
    )


def is_batch_job(name: Column, ports: Column, environment: Column, essential: Column) -> Column:
    """A word in the name, an empty (not a missing) port list, a telling variable, or not essential."""
    word = F.lower(name).rlike("|".join(rules.BATCH_WORDS))
    variable = F.exists(
        environment,
        lambda e: F.coalesce(F.lower(e["name"]).rlike("cron|schedule"), F.lit(False))
        | F.coalesce(F.contains(F.lower(e["value"]), F.lit("cron")), F.lit(False)),
    )
    no = F.lit(False)
    return (
        F.coalesce(word, no)
        | F.coalesce(F.size(ports) == 0, no)
        | F.coalesce(variable, no)
        | F.coalesce(~essential, no)
    )


def health_check_path(command: Column, environment: Column) -> Column:
    """From the command text, else from the first HEALTH_CHECK_PATH variable, else /health."""
    text = F.array_join(command, " ")
    in_command = F.nullif(F.regexp_extract(text, r"http://localhost:8080([^\s]+)", 1), F.lit(""))
    variables = F.filter(
        environment, lambda e: F.coalesce(F.lower(e["name"]) == "health_check_path", F.lit(False))
    )
    value = F.try_element_at(variables, F.lit(1))["value"]
    from_variable = F.when(
        ~is_blank(value), F.when(F.startswith(value, F.lit("/")), value).otherwise(F.concat(F.lit("/"), value))
    )
    return F.coalesce(in_command, from_variable, F.lit("/health"))


def health_check(containers: DataFrame) -> DataFrame:
    """Add ``health``: kind (none, custom or standard), command, interval, timeout, retries, start.

    ``healthCheck.disabled`` does not disable: it falls through to the standard check. An
    empty command gives the standard check on the default path.
    """
    check, env = F.col("healthCheck"), F.col("environment")
    off = F.coalesce(F.col("disableHealthCheck"), F.lit(False)) | is_batch_job(
        F.col("name"), F.col("portMappings"), env, F.col("essential")
    )
    has_command = F.coalesce(F.size(check["command"]) > 0, F.lit(False))
    enabled = check.isNotNull() & ~F.coalesce(check["disabled"], F.lit(False))
    custom = enabled & has_command
    path = F.when(enabled & ~has_command, F.lit("/health")).otherwise(health_check_path(check["command"], env))
    standard_command = F.concat(
        F.lit("CMD-SHELL wget --no-verbose --tries=1 --spider http://localhost:8080"), path, F.lit(" || exit 1")
    )

    def timing(field: str, default: int) -> Column:
        given = F.when(custom, check[field])
        return F.when(~off, F.coalesce(given, F.lit(default)))

    return containers.withColumn(
        "health",
        F.struct(
            F.when(off, "none").when(custom, "custom").otherwise("standard").alias("kind"),
            F.when(~off, F.when(custom, F.array_join(check["command"], " ")).otherwise(standard_command)).alias("command"),
            timing("interval", rules.HEALTH_INTERVAL).alias("interval"),
            timing("timeout", rules.HEALTH_TIMEOUT).alias("timeout"),
            timing("retries", rules.HEALTH_RETRIES).alias("retries"),
            timing("startPeriod", rules.HEALTH_START).alias("start_period"),
        ),
    )


def uses_placeholder(image: Column) -> Column:
    return is_blank(image) | (image == "placeholder")


def effective_env(containers: DataFrame) -> DataFrame:
    """Add ``env_vars`` to containers that carry the columns of their context.

    Defaults, then defaults by container name, then configured pairs with a name and a
    value. A placeholder image ignores the configured pairs and adds four of its own.
    """
    env = F.col("env_name")
    defaults = maps.text_map(
        {
            "ENVIRONMENT": env,
            "ACCOUNT_TYPE": F.col("account_type"),
            "APP_VERSION": rules.IMAGE_VERSION,
            "PORT": str(rules.PREFERRED_PORT),
            "HEALTH_CHECK_PATH": "/health",
            "AWS_REGION": F.col("region"),
            "AWS_ACCOUNT_ID": F.col("account_id"),
        }
    )
    known = F.lower(env).isin([e[0].lower() for e in rules.ENVIRONMENTS])
    by_name = F.when(
        ~uses_placeholder(F.col("image")) & (F.lower("name") == rules.NAMED_ENV_CONTAINER),
        maps.text_map({"ASPNETCORE_ENVIRONMENT": F.when(known, F.initcap(env)).otherwise("Development")}),
    )
    pairs = F.filter("environment", lambda e: ~is_empty(e["name"]) & ~is_empty(e["value"]))
    placeholder = maps.text_map(
        {
            "DEPLOYMENT_TYPE": "placeholder",
            "MANAGED_BY": "CDK",
            "APP_NAME": F.col("app_name"),
            "APP_VERSION": rules.IMAGE_VERSION,
        }
    )
    standby = uses_placeholder(F.col("image"))
    df = maps.map_of_last(containers, "_configured", F.when(~standby, pairs), "name")
    df = maps.overlay(df, "env_vars", defaults, by_name, F.when(standby, placeholder).otherwise(F.col("_configured")))
    return df.drop("_configured")
