"""One query per operator, over the whole of the driver's tables.

Every query takes (spark, sf_dir) and returns a DataFrame. Nested results are returned as
rows or as sorted text so that they compare by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions import maps, naming
from fleetlens.operators import config, containers, inventory, names, policy, requirements, secrets, topology, traffic
from fleetlens.plans import audits
from fleetlens.plans import fleet_tables as fleet
from fleetlens.session import checkpointed, remove_folder, shared_folder
from fleetlens.sources import documents, files, findings
from fleetlens.streaming import drift

SETTINGS = fleet.SETTINGS
RESOURCE = ["l_orderkey", "l_linenumber"]
CONTAINER = ["l_orderkey", "l_linenumber", "name"]


def _text(c) -> F.Column:
    return F.array_join(c, ",")


# --- sources -----------------------------------------------------------------------------


def s1(spark: SparkSession, sf: str) -> DataFrame:
    parsed = documents.parse_environments(fleet.fleet_table(spark, sf, "registry_texts"))
    return parsed.select(
        "registry_id", "env_name", "account_id", "account_type", "region", maps.map_text(F.col("tags")).alias("tags"), "error"
    )


def s1_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of registries read by two runs: after all are written, and after some came, changed or went."""
    path = f"{shared_folder(spark)}/registries-{uuid.uuid4().hex}"
    folder, ledger = f"{path}/files", f"{path}/ledger"
    texts = fleet.fleet_table(spark, sf, "registry_files")
    for run in (1, 2):
        fleet.write_documents(texts.filter(F.col("step") == run).drop("step"), folder, run)
        if run == 2:
            remove_folder(spark, f"{folder}/shelf=b")
        changes = files.stage_changes(spark, folder, ledger, run, "*.txt", r"/doc=(\d+)/")
        read = files.read_changed(changes, folder).withColumn("run", F.lit(run))
        parsed = documents.parse_environments(read.select("run", "name", "change", "file_error", "text"))
        findings.write_run(parsed.drop("tags"), f"{path}/parsed", f"run-{run}")
        files.commit_changes(spark, ledger, run)
    parsed = findings.read_findings(spark, f"{path}/parsed/*")
    found = checkpointed(
        parsed.select(
            "run", F.col("name").cast("bigint").alias("doc"), "change", "env_name", "account_id",
            F.when(F.col("change") != "removed", F.coalesce("file_error", "error")).alias("error"),
        )
    )
    remove_folder(spark, path)
    return found


def s2(spark: SparkSession, sf: str) -> DataFrame:
    return config.merge_layers(fleet.fleet_table(spark, sf, "layers"))


def service_docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.parse_service_configs(fleet.dealt(spark, sf, "service_texts", "lineitem", ["l_orderkey"]))


def s3(spark: SparkSession, sf: str) -> DataFrame:
    docs = service_docs(spark, sf)
    return docs.select(
        "doc_id", "env_name", "error",
        F.col("doc.vpcNamePattern").alias("vpc_name_pattern"),
        F.col("doc.ecsConfiguration.serviceName").alias("service_name"),
        F.size("doc.ecsConfiguration.taskDefinition").alias("n_tasks"),
        F.size(F.try_element_at("doc.ecsConfiguration.taskDefinition", F.lit(1))["containerDefinitions"]).alias("n_containers"),
    )


def s3_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts whose environment has no readable service document."""
    environments = fleet.contexts(spark, sf).select("context_id", "env_name")
    readable = service_docs(spark, sf).groupBy("context_id", "env_name").agg(F.bool_or(F.col("error").isNull()).alias("readable"))
    return documents.missing_service_configs(environments, readable.filter("readable"), ["context_id"])


def policies(spark: SparkSession, sf: str) -> DataFrame:
    return documents.parse_policies(fleet.fleet_table(spark, sf, "policy_docs"))


def s4(spark: SparkSession, sf: str) -> DataFrame:
    conditions = F.transform(
        "conditions", lambda c: F.concat_ws("|", c["op"], c["key"], F.array_join(c["patterns"], "/"))
    )
    return policies(spark, sf).select(
        "policy_id", "statement_no", "sid", "effect", _text("actions").alias("actions"),
        _text("resources").alias("resources"), _text("not_actions").alias("not_actions"),
        _text("not_resources").alias("not_resources"), "principal", _text(conditions).alias("conditions"), "error",
    )


def s5(spark: SparkSession, sf: str) -> DataFrame:
    parts = documents.parse_manifest(fleet.fleet_table(spark, sf, "manifest_texts"))
    nodes = parts["nodes"].select(
        "manifest_id", F.lit("node").alias("part"), "stack",
        F.concat_ws(":", "stack_id", F.col("declared_order").cast("string")).alias("value"),
    )
    edge = lambda key, column: parts[key].select(
        "manifest_id", F.lit(key).alias("part"), "stack", F.col(column).alias("value")
    )
    return nodes.unionAll(edge("deps", "depends_on")).unionAll(edge("exports", "name")).unionAll(edge("imports", "name"))


def s6(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    found = audits.name_findings(fleet.inventory(spark, sf), SETTINGS, [*RESOURCE, "env_name", "kind"])
    findings.write_findings(found, path, ["kind"])
    written = checkpointed(findings.read_findings(spark, path))
    remove_folder(spark, path)
    return written


def s6_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run written twice and another once; each is there once."""
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    found = audits.name_findings(fleet.inventory(spark, sf), SETTINGS, [*RESOURCE, "env_name", "kind"])
    findings.write_run(found.limit(10), path, "first", ["kind"])
    findings.write_run(found, path, "first", ["kind"])
    findings.write_run(found.filter("env_name = 'Development'"), path, "second", ["kind"])
    written = checkpointed(findings.read_findings(spark, path).filter("run = 'second' OR kind = 'Storage' OR env_name = 'Production'"))
    remove_folder(spark, path)
    return written


# --- names -------------------------------------------------------------------------------


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.inventory(spark, sf)


def named(column):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return resolved(spark, sf).select(*RESOURCE, column().alias("resource_name"))

    return query


def n1(spark: SparkSession, sf: str) -> DataFrame:
    return names.resolve_context(fleet.fleet_table(spark, sf, "fleet_resources"), SETTINGS).select(
        *RESOURCE, "env_name", "app_name", "region", "env_prefix", "account_type", "app_code", "region_code",
        _text("errors").alias("errors"),
    )


def type_code():
    return F.substring_index("kind", "_", 1)


def n8(spark: SparkSession, sf: str) -> DataFrame:
    df = resolved(spark, sf).withColumn("account_id", F.concat(F.lit("10000000000"), (F.col("l_orderkey") % 4).cast("string")))
    service = F.element_at(
        F.array(*[F.lit(s) for s in ("iam", "iam", "iam", "s3", "sqs", "sns", "iam", "s3")]), F.col("kind_id") + 1
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in ("role", "policy", "user")]), F.col("kind_id") % 3 + 1)
    bucket = naming.bucket_name(SETTINGS, F.lit("docs"))
    name = F.when(service == "s3", bucket).otherwise(naming.application_name(kind, F.lit("main")))
    return df.select(*RESOURCE, service.alias("service"), naming.arn(service, kind, name).alias("arn"))


def n9(spark: SparkSession, sf: str) -> DataFrame:
    stack = F.element_at(
        F.array(*[F.lit(s) for s in ("app", "base", "ALB", "ecs", "Data", "COGNITO", "other", "app")]), F.col("kind_id") + 1
    )
    return resolved(spark, sf).select(*RESOURCE, stack.alias("stack"), naming.stack_name(stack).alias("stack_name"))


def n10(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select(
        *RESOURCE,
        naming.export_name(F.lit("alb-arn")).alias("app_export"),
        naming.export_name(F.lit("vpc-id"), app=None).alias("env_export"),
        naming.secret_path(F.col("kind")).alias("secret_path"),
        naming.stack_role_name("task").alias("task_role"),
        naming.auth_domain_prefix().alias("auth_domain"),
    )


def n11(spark: SparkSession, sf: str) -> DataFrame:
    return names.audit_names(fleet.inventory(spark, sf), SETTINGS).select(
        *RESOURCE, "kind", "observed_name", "expected_name", "is_valid"
    )


def n11_purposes(spark: SparkSession, sf: str) -> DataFrame:
    """Resources named for a purpose of another family; every tenth claims a storage purpose."""
    rows = fleet.inventory(spark, sf).withColumn("specific", F.when(F.col("noise") == 5, "uploads").otherwise(F.col("specific")))
    return names.purpose_violations(rows).select(*RESOURCE, "kind", "specific", "expected_family")


def n12(spark: SparkSession, sf: str) -> DataFrame:
    observed = fleet.inventory(spark, sf).select(*RESOURCE, "kind", F.col("observed_name").alias("name"))
    padded = observed.withColumn("name", F.concat("name", F.repeat(F.lit("-long"), F.col("l_linenumber"))))
    limits = rules.name_limits(spark)
    return names.name_limit_violations(padded, limits).select(
        *RESOURCE, "kind", "name", _text("problems").alias("problems")
    )


def n13(spark: SparkSession, sf: str) -> DataFrame:
    seen = fleet.inventory(spark, sf).select("account_type", "env_name", F.col("observed_name").alias("name"))
    return names.name_collisions(seen).select("account_type", "lower_name", _text("environments").alias("environments"))


def n14(spark: SparkSession, sf: str) -> DataFrame:
    envs = fleet.contexts(spark, sf).select("context_id", "env_name", "account_type", "account_id")
    group = lambda by: names.siblings(envs, by).select(F.lit(by).alias("grouped_by"), F.col(by).alias("account"), _text("siblings").alias("siblings"))
    return group("account_type").unionByName(group("account_id"))


def n15(spark: SparkSession, sf: str) -> DataFrame:
    envs = fleet.contexts(spark, sf).select(
        "env_name",
        F.when(F.col("context_id") % 11 != 0, F.col("account_id")).alias("account_id"),
        F.when(F.col("version") == "vP", "nonsense").when(F.col("version") == "vO", None).otherwise(F.col("account_type")).alias("account_type"),
    )
    return names.environments_by_account(envs).select(
        "account_id", "account_type", _text("environments").alias("environments"), "n_rows"
    )


def n16(spark: SparkSession, sf: str) -> DataFrame:
    dim = rules.rule_table(
        spark, "app_name string, app_code string", [*SETTINGS.applications, ("Taken", "n7"), ("Other", "n11")]
    )
    new = fleet.fleet_table(spark, sf, "new_codes")
    registered, rejects = names.register_codes(dim, new, "app_name", "app_code", "seq")
    accepted = registered.withColumn("outcome", F.lit("registered"))
    return accepted.unionByName(rejects.select("app_name", "app_code", F.col("reason").alias("outcome")))


# --- configuration -----------------------------------------------------------------------


def k1(spark: SparkSession, sf: str) -> DataFrame:
    return containers.explode_containers(service_docs(spark, sf)).select(
        "doc_id", "task_no", "task", "pos", "name", "image", "essential",
        F.size("portMappings").alias("n_ports"), _text("secrets").alias("secrets"),
    )


def k1_ports(spark: SparkSession, sf: str) -> DataFrame:
    rows = containers.explode_containers(service_docs(spark, sf))
    return containers.explode_ports(rows, ["doc_id", "pos"]).select(
        "doc_id", "pos", "port_no", F.col("containerPort").alias("container_port"), "protocol"
    )


def k1_environment(spark: SparkSession, sf: str) -> DataFrame:
    return containers.explode_environment(fleet.containers(spark, sf), CONTAINER)


def k1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    rows = containers.explode_containers(service_docs(spark, sf))
    return containers.explode_secrets(rows, ["doc_id", "pos"])


def k2(spark: SparkSession, sf: str) -> DataFrame:
    return containers.container_violations(service_docs(spark, sf).select("doc_id", "doc"))


def k3(spark: SparkSession, sf: str) -> DataFrame:
    return containers.duplicate_names(fleet.containers(spark, sf), ["doc_id"])


def k4(spark: SparkSession, sf: str) -> DataFrame:
    template = (
        "${ENVIRONMENT}/${ACCOUNT_TYPE}/${APP_VERSION}/${AWS_REGION}/${SERVICE_NAME}/${TASK_DEFINITION_FAMILY}"
        "/${LOG_GROUP_NAME}/${ENVIRONMENT}/${TASK_ROLE_ARN}/${CERTIFICATE_ARN}/${TASK_ROLE_ARN}"
    )
    df = fleet.resolved_contexts(spark, sf).withColumn(
        "text", F.when(F.col("context_id") % 3 == 0, F.lit("plain $ENVIRONMENT {x}")).otherwise(F.lit(template))
    )
    return config.substitute(df, "text", config.substitution_values(SETTINGS)).select(
        "context_id", "text", _text("unresolved").alias("unresolved")
    )


def map_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """Entries of a map as rows. The outer form keeps Catalyst from building the map twice, once to filter on its size."""
    return df.select("context_id", F.explode_outer(column).alias(key, "value")).filter(F.col(key).isNotNull())


def tagged_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.contexts(spark, sf).withColumns(
        {
            "tags": F.when(
                F.col("context_id") % 4 != 0,
                maps.text_map({"Environment": "OverrideValue", "Owner": F.col("priority"), "StackType": "mine"}),
            ),
            "commit": F.when(F.col("context_id") % 3 != 0, F.concat(F.lit("abcdef"), F.col("context_id").cast("string"), F.lit("xyz"))),
            "deployment_id": F.concat(F.lit("d"), F.col("context_id").cast("string")),
        }
    )


def k5(spark: SparkSession, sf: str) -> DataFrame:
    stack = F.when(F.col("context_id") % 2 == 0, config.shared_stack_tags()).otherwise(config.application_stack_tags())
    merged = config.merge_tags(tagged_contexts(spark, sf), stack)
    return map_rows(merged, "merged_tags", "tag")


def k6(spark: SparkSession, sf: str) -> DataFrame:
    df = config.effective_settings(fleet.contexts(spark, sf))
    return map_rows(df, "settings", "key")


def k7(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of partly shipped orders count as not registered: their containers have an error instead."""
    context = fleet.contexts(spark, sf).select(
        F.col("context_id").alias("doc_id"), "env_name", "app_name", "account_type", "region", "account_id",
        (F.col("version") != "vP").alias("known"),
    )
    rows = fleet.containers(spark, sf).drop("env_name", "app_name").join(context.filter("known"), "doc_id", "left")
    found = F.col("known").isNotNull()
    return containers.effective_env(rows).select(
        *CONTAINER, "image", F.when(found, maps.map_text(F.col("env_vars"))).alias("env_vars"),
        F.when(~found, "no context for the document").alias("error"),
    )


def k8(spark: SparkSession, sf: str) -> DataFrame:
    df = config.settings_to_env(config.effective_settings(fleet.contexts(spark, sf)))
    return map_rows(df, "env_vars", "variable")


def k9(spark: SparkSession, sf: str) -> DataFrame:
    return config.effective_override(fleet.contexts(spark, sf), rules.overrides(spark)).select(
        "context_id", "env_name", "enhanced_monitoring", "backup_days"
    )


def _sizing(df: DataFrame) -> DataFrame:
    return df.select(
        "context_id", "env_name", *[c for c, _ in rules.SIZING_COLUMNS], "cpu_units", "zones", "deletion_protection"
    )


def k10_policy(spark: SparkSession, sf: str) -> DataFrame:
    return _sizing(config.sizing_policy(fleet.contexts(spark, sf)))


def k10_effective(spark: SparkSession, sf: str) -> DataFrame:
    return _sizing(config.sizing_effective(fleet.contexts(spark, sf)))


def k11(spark: SparkSession, sf: str) -> DataFrame:
    return config.security_defaults(fleet.contexts(spark, sf)).select(
        "context_id", "account_type", "enable_waf", _text("allowed_cidrs").alias("allowed_cidrs")
    )


def k12(spark: SparkSession, sf: str) -> DataFrame:
    return config.retention(fleet.contexts(spark, sf)).select("context_id", "env_name", "subject", "rule", "days")


def k12_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = config.retention(fleet.contexts(spark, sf), documented=True)
    return config.retention_conflicts(rows).select("env_name", "subject", _text("days").alias("days"))


def k13(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.containers(spark, sf).select(*CONTAINER, containers.container_port(F.col("portMappings")).alias("port"))


def k14(spark: SparkSession, sf: str) -> DataFrame:
    return containers.primary_container(fleet.containers(spark, sf), ["doc_id"], fleet.LIST_ORDER)


def k14_first_task(spark: SparkSession, sf: str) -> DataFrame:
    """The primary container of the first task only, which is the one that is deployed."""
    rows = containers.explode_containers(service_docs(spark, sf)).filter("task_no = 0")
    rows = rows.withColumn("port", containers.container_port(F.col("portMappings")))
    return containers.primary_container(rows, ["doc_id"], ["pos", "port"])


def k15(spark: SparkSession, sf: str) -> DataFrame:
    ports = containers.normalised_ports(F.col("name"), F.col("portMappings"))
    return fleet.containers(spark, sf).select(
        *CONTAINER, F.inline_outer(ports).alias("mapping_name", "container_port", "host_port", "protocol", "app_protocol")
    ).filter(F.col("container_port").isNotNull())


def k16(spark: SparkSession, sf: str) -> DataFrame:
    flag = containers.is_batch_job(F.col("name"), F.col("portMappings"), F.col("environment"), F.col("essential"))
    return fleet.containers(spark, sf).select(*CONTAINER, flag.alias("is_batch_job"))


def k17(spark: SparkSession, sf: str) -> DataFrame:
    return containers.health_check(fleet.containers(spark, sf)).select(*CONTAINER, "health.*")


def k18(spark: SparkSession, sf: str) -> DataFrame:
    df = fleet.fleet_table(spark, sf, "secret_requests")
    name = secrets.secret_name(F.col("variable"))
    return df.select("l_orderkey", "variable", name.alias("secret_name"), naming.secret_path(name).alias("path"))


def t1_secret_exports(spark: SparkSession, sf: str) -> DataFrame:
    df = fleet.fleet_table(spark, sf, "secret_requests")
    return topology.secret_exports(df.withColumn("secret_name", secrets.secret_name(F.col("variable"))))


def k19(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.distinct_secrets(fleet.containers(spark, sf), ["doc_id"])


def k20(spark: SparkSession, sf: str) -> DataFrame:
    df = fleet.fleet_table(spark, sf, "secret_requests")
    requested = df.select(naming.secret_path(secrets.secret_name(F.col("variable"))).alias("path"), "variable", "request_no")
    plan = secrets.secret_plan(requested, fleet.fleet_table(spark, sf, "existing_secrets"), "request_no")
    return plan.withColumn("variables", _text("variables"))


def k21(spark: SparkSession, sf: str) -> DataFrame:
    df = fleet.fleet_table(spark, sf, "container_rows")
    name = secrets.secret_name(F.col("secret_var"))
    return df.select(
        "l_orderkey", "l_linenumber", name.alias("secret_name"), secrets.is_identity_secret(name).alias("is_identity")
    )


def k22(spark: SparkSession, sf: str) -> DataFrame:
    return config.redirect_urls(fleet.contexts(spark, sf), SETTINGS).select(
        "context_id", "purpose", "pos", "url", "is_https"
    )


# --- requirements, tags and drift --------------------------------------------------------


def required_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Requirements of all contexts; the account type of every 23rd is unknown."""
    known = F.when(F.col("context_id") % 23 != 0, F.col("account_type"))
    return requirements.requirements(fleet.resolved_contexts(spark, sf).withColumn("account_type", known))


def q1(spark: SparkSession, sf: str) -> DataFrame:
    return required_roles(spark, sf).select(
        "context_id", "resource_type", "purpose", "expected_name", "expected_arn", _text("rules").alias("rules"),
        maps.map_text(F.col("expected_tags")).alias("tags"),
    )


def role_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Roles that some context of an open order created, without those in us-west-2 for storage; half are listed twice."""
    created = required_roles(spark, sf).filter("version <> 'vP' AND expected_name IS NOT NULL").filter(
        ~((F.col("region") == "us-west-2") & (F.col("purpose") == "S3Access"))
        & ~((F.col("region") == "us-east-1") & (F.col("account_id") == "100000000000") & (F.col("purpose") == "EcsTask"))
    )
    once = created.groupBy("account_id", F.col("expected_name").alias("role_name")).agg(
        F.max(F.when(F.col("app_name") == "AppOne", f"Principal {rules.TASK_SERVICE}").otherwise("Principal lambda")).alias("trust_document"),
        F.max(
            F.when(F.col("region") != "us-west-1", F.array(F.lit(f"arn:aws:iam::aws:policy/service-role/{rules.EXECUTION_POLICY}")))
        ).alias("policy_arns"),
    )
    # the second listing of a role has other documents, greater in order, that pass no check
    again = F.explode(F.sequence(F.lit(0), F.length("role_name") % 2))
    copies = once.withColumn("_copy", again)
    other = {"trust_document": F.lit("Principal zz"), "policy_arns": F.array(F.lit("arn:zz"))}
    return copies.withColumns({c: F.when(F.col("_copy") == 0, F.col(c)).otherwise(v) for c, v in other.items()}).drop("_copy")


def checked_roles(spark: SparkSession, sf: str) -> DataFrame:
    return requirements.check_roles(required_roles(spark, sf), role_inventory(spark, sf))


def q2(spark: SparkSession, sf: str) -> DataFrame:
    return checked_roles(spark, sf).select(
        "context_id", "purpose", "expected_name", "exists", "follows_name", "has_permissions",
        _text("errors").alias("errors"), _text("warnings").alias("warnings"), "is_valid",
    )


def q3(spark: SparkSession, sf: str) -> DataFrame:
    return requirements.summarise(checked_roles(spark, sf), ["env_name", "account_id"]).drop("no_context")


def q3_levels(spark: SparkSession, sf: str) -> DataFrame:
    levels = [["env_name", "account_id"], ["account_id"], []]
    return requirements.summarise(checked_roles(spark, sf), ["env_name", "account_id"], levels).drop("no_context")


def q3_messages(spark: SparkSession, sf: str) -> DataFrame:
    results = checked_roles(spark, sf).withColumn("resource", F.concat_ws(":", "resource_type", "purpose"))
    return requirements.summary_messages(results, ["env_name", "account_id"], "resource")


def q4(spark: SparkSession, sf: str) -> DataFrame:
    return requirements.all_valid(checked_roles(spark, sf))


def q4_errors(spark: SparkSession, sf: str) -> DataFrame:
    return requirements.all_errors(checked_roles(spark, sf), ["context_id", "purpose"])


def q5(spark: SparkSession, sf: str) -> DataFrame:
    return requirements.requirement_report(required_roles(spark, sf))


def q6(spark: SparkSession, sf: str) -> DataFrame:
    results = fleet.fleet_table(spark, sf, "layers").select(
        "scope", F.concat(F.lit("IamRole:"), "key").alias("resource"), (F.col("value") > 20).alias("is_valid"),
        F.col("priority").alias("sequence"),
    )
    return requirements.last_results(results, ["scope", "resource"], "sequence")


def q7(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.fleet_table(spark, sf, "tag_rows")
    resources = rows.withColumn(
        "tags", maps.text_map({"Environment": F.col("environment"), "Application": F.col("application")})
    )
    required = rules.rule_table(
        spark, "scope string, tag string, expected string",
        [
            ("secret", "Environment", "Development"), ("secret", "Application", "BUILDING"),
            ("role", "Environment", "Development"), ("role", "Application", None),
            ("role", "ManagedBy", "CDK"),
        ],
    )
    return inventory.tag_violations(resources, required, ["resource_id"])


def q8(spark: SparkSession, sf: str) -> DataFrame:
    services = fleet.fleet_table(spark, sf, "services")
    return inventory.endpoint_availability(fleet.fleet_table(spark, sf, "endpoints"), services)


def q9(spark: SparkSession, sf: str) -> DataFrame:
    required = fleet.fleet_table(spark, sf, "tag_rows").select("resource_id")
    return inventory.existence(required, fleet.fleet_table(spark, sf, "order_keys"), ["resource_id"])


def q10(spark: SparkSession, sf: str) -> DataFrame:
    found = inventory.drift(
        fleet.fleet_table(spark, sf, "expected_state"), fleet.fleet_table(spark, sf, "actual_state"), ["id"],
        ["status", "tier", "price"],
    )
    return found.select("id", "change", F.col("column").alias("field"), F.col("from").alias("old_value"), F.col("to").alias("new_value"))


def q10_ranges(spark: SparkSession, sf: str) -> DataFrame:
    levels = [F.floor(F.col("id") / 4096), F.floor(F.col("id") / 64)]
    found = inventory.drift_by_ranges(
        fleet.fleet_table(spark, sf, "expected_state"), fleet.fleet_table(spark, sf, "actual_state"), ["id"], ["status", "tier", "price"], levels
    )
    return found.select("id", "change", F.col("column").alias("field"), F.col("from").alias("old_value"), F.col("to").alias("new_value"))


def q10_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Registries against those in force, which are spelled and ordered in another way."""

    def parsed(name: str) -> DataFrame:
        texts = documents.relaxed_json(fleet.fleet_table(spark, sf, name), "text")
        return texts.select("registry_id", F.try_parse_json("text").alias("document"))

    found = inventory.document_drift(parsed("registry_texts"), parsed("registry_actual"), ["registry_id"], "document")
    return found.select("registry_id", "path", "change", F.col("from").alias("old_value"), F.col("to").alias("new_value"))


def q11(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.rule_differences(
        fleet.fleet_table(spark, sf, "expected_state"), fleet.fleet_table(spark, sf, "actual_state"), ["status", "tier"]
    )


# --- topology ----------------------------------------------------------------------------


EXPORT = ["account_no", "region", "name"]


def published(spark: SparkSession, sf: str) -> DataFrame:
    """Exports of the stacks that are deployed; the others are declared only."""
    return fleet.fleet_table(spark, sf, "exports").filter("published").drop("published")


def t1(spark: SparkSession, sf: str) -> DataFrame:
    return topology.unresolved_imports(fleet.fleet_table(spark, sf, "imports"), published(spark, sf), EXPORT)


def t1_expected(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of the stacks of each context that none of the stacks there would export."""
    base = fleet.contexts(spark, sf).select("env_name", "app_name").distinct()
    missing = topology.unresolved_imports(
        topology.expected_imports(base), topology.expected_exports(base), ["env_name", "app_name", "name"]
    )
    return missing.select("env_name", "app_name", "stack", F.col("name").alias("import_name"))


def t2(spark: SparkSession, sf: str) -> DataFrame:
    return topology.duplicate_exports(published(spark, sf), EXPORT)


def t3(spark: SparkSession, sf: str) -> DataFrame:
    return topology.deploy_levels(fleet.fleet_table(spark, sf, "stack_nodes"), fleet.fleet_table(spark, sf, "stack_deps"))


def t4(spark: SparkSession, sf: str) -> DataFrame:
    return topology.undeclared_dependencies(
        fleet.fleet_table(spark, sf, "imports"), published(spark, sf),
        fleet.fleet_table(spark, sf, "declared_deps").filter("declared"), EXPORT, stack="stack_id",
    )


def t5(spark: SparkSession, sf: str) -> DataFrame:
    return topology.list_import_items(fleet.fleet_table(spark, sf, "list_exports"))


def t5_join(spark: SparkSession, sf: str) -> DataFrame:
    """Items split and joined again: the export side."""
    return topology.join_list_export(t5(spark, sf), ["export_id"])


# --- policy ------------------------------------------------------------------------------


def p1(spark: SparkSession, sf: str) -> DataFrame:
    flat = policy.flatten_statements(policies(spark, sf))
    return flat.select(
        "policy_id", "statement_no", "sid", "effect", "action", "resource", _text("not_actions").alias("not_actions"),
        _text("not_resources").alias("not_resources"), "error",
    )


def p2(spark: SparkSession, sf: str) -> DataFrame:
    return policy.policy_checks(
        policies(spark, sf), ["policy_id"], ["secretsmanager:GetSecretValue", "kms:Decrypt"], "/dev/"
    )


def p2_strict(spark: SparkSession, sf: str) -> DataFrame:
    return policy.policy_checks(
        policies(spark, sf), ["policy_id"], ["secretsmanager:GetSecretValue", "kms:Decrypt"], "/dev/", strict_arrays=True
    )


# principal, sid, effect, actions, resources, condition (op, key, patterns)
SAMPLE_STATEMENTS = [
    ("role-0", "OwnSecrets", "Allow", ["secretsmanager:Get*", "secretsmanager:DescribeSecret"], ["/development/app.one/*", "/development/shared/*"], None),
    ("role-0", "Decrypt", "Allow", ["kms:Decrypt"], ["*"], ("StringEquals", "kms:ViaService", ["secretsmanager.us-east-2.amazonaws.com"])),
    ("role-0", "NoOther", "Deny", ["secretsmanager:*"], ["*"], ("ForAnyValue:StringLike", "secretsmanager:SecretId", ["/production/*", "/staging/*", "/integration/*"])),
    ("role-1", "Wide", "Allow", ["*"], ["/integration/*"], None),
    ("role-1", "NoKeys", "Deny", ["s3:?etObject"], ["*/shared/*"], None),
    ("role-1", "Region", "Allow", ["ecs:List*"], ["*"], ("StringLike", "kms:ViaService", ["*.us-east-?.amazonaws.com", "x"])),
    ("role-2", "Odd", "Allow", ["s*:Get*"], ["/staging/app?one/*", "/st(a)ging"], None),
    ("role-2", "Exact", "Allow", ["KMS:decrypt"], ["/production/app.one/key"], None),
    ("role-2", "Upper", "Deny", ["ecs:*"], ["/STAGING/*"], None),
    ("role-3", "Most", "Allow", ["*"], ["*"], None),
    ("role-3", "Unless", "Deny", ["ecs:*", "kms:*"], ["/staging/*", "/development/*"], ("StringNotEquals", "kms:ViaService", ["x"])),
    ("role-3", "Never", "Deny", ["kms:Dec*"], ["/development/*"], ("StringLike", "kms:ViaService", ["*.us-*"])),
]


def sample_statements(spark: SparkSession, with_conditions: bool) -> DataFrame:
    rows = [(p, s, e, a, r, *(c or (None, None, None))) for p, s, e, a, r, c in SAMPLE_STATEMENTS]
    table = rules.rule_table(
        spark, "principal string, sid string, effect string, actions strings, resources strings, op string, key string, patterns strings", rows
    )
    condition = F.when(F.col("op").isNotNull(), F.array(F.struct("op", "key", "patterns")))
    if with_conditions:
        table = table.withColumn("conditions", condition)
    return policy.flatten_statements(table.drop("op", "key", "patterns"))


def p3(spark: SparkSession, sf: str) -> DataFrame:
    """Requests repeat and lack ids, and some lack an action: ids play no part."""
    requests = fleet.fleet_table(spark, sf, "access_requests").drop("via_service")
    return policy.evaluate(requests, sample_statements(spark, False), ["principal"])


def p4(spark: SparkSession, sf: str) -> DataFrame:
    requests = fleet.fleet_table(spark, sf, "access_requests")
    context = F.map_filter(
        F.create_map(
            F.lit("kms:ViaService"), F.array("via_service"), F.lit("secretsmanager:SecretId"), F.array("resource")
        ),
        lambda _, v: v[0].isNotNull(),
    )
    return policy.evaluate(
        requests.withColumn("context", context), sample_statements(spark, True), ["principal"]
    ).select("request_id", "decision", "matched_sid")


def p4_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    return policy.unsupported_conditions(policies(spark, sf)).select("policy_id", "statement_no", "sid", "op", "key")


def p5(spark: SparkSession, sf: str) -> DataFrame:
    conditions = F.transform("conditions", lambda c: F.concat_ws("|", c["op"], c["key"], F.array_join(c["patterns"], ";")))
    return policy.isolation_rules(fleet.contexts(spark, sf)).select(
        "context_id", "sid", "effect", _text("actions").alias("actions"), _text("resources").alias("resources"),
        _text(conditions).alias("conditions"),
    )


# role, audience, subject pattern
SAMPLE_TRUST = [
    ("dev-deploy", "sts.amazonaws.com", "repo:org/app:ref:refs/heads/develop"),
    ("dev-deploy", "sts.amazonaws.com", "repo:org/app:ref:refs/heads/feature/*"),
    ("dev-deploy", "sts.amazonaws.com", "repo:org/app:pull_request"),
    ("dev-deploy", "sts.amazonaws.com", "repo:org/app:ref:refs/heads/*"),
    ("prod-deploy", "sts.amazonaws.com", "repo:org/app:ref:refs/heads/main"),
    ("prod-deploy", "sts.amazonaws.com", "repo:org/app:ref:refs/heads/master"),
]


def p6(spark: SparkSession, sf: str) -> DataFrame:
    trust = rules.rule_table(spark, "role string, audience string, pattern string", SAMPLE_TRUST)
    return policy.trust_matches(fleet.fleet_table(spark, sf, "ci_subjects"), trust)


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What the documents of each role decide about each distinct subject that they may let in."""
    statements = documents.parse_policies(fleet.fleet_table(spark, sf, "trust_docs"))
    return policy.trust_decisions(fleet.fleet_table(spark, sf, "ci_subjects"), statements, "policy_id", shown=_text)


# --- traffic -----------------------------------------------------------------------------

# port, priority, pattern, target
SAMPLE_ROUTES = [
    (443, 100, "/en/*", "english"),
    (443, 10, "/en/1*", "english-one"),
    (443, 50, "/?r/*", "french"),
    (80, 100, "/app/*", "app"),
    (80, 20, "/e?/*", "e-language"),
    (80, 30, "/en/*", "never"),
]
AS_OF = "1998-06-01"


def r1(spark: SparkSession, sf: str) -> DataFrame:
    routes = rules.rule_table(spark, "port int, priority int, pattern string, target string", SAMPLE_ROUTES)
    """Request ids repeat and are missing; paths are whole."""
    return traffic.route(fleet.fleet_table(spark, sf, "http_requests"), routes)


def r1_many(spark: SparkSession, sf: str) -> DataFrame:
    """The same over six rules for every part, with equal and missing priorities."""
    return traffic.route(fleet.fleet_table(spark, sf, "http_requests"), fleet.dealt(spark, sf, "many_routes", "part", ["p_partkey"]))


def r2(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.health_states(fleet.fleet_table(spark, sf, "probes")).select("target", "event_id", "ok", "state")


def r3(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.lifecycle(fleet.fleet_table(spark, sf, "objects"), rules.lifecycle(spark), AS_OF)


def r4(spark: SparkSession, sf: str) -> DataFrame:
    limits = rules.rule_table(spark, "queue string, max_receives int", [("view", 1), ("click", 2), ("error", 1)])
    return traffic.dead_letters(fleet.fleet_table(spark, sf, "messages"), limits, "2024-02-01")


def r5(spark: SparkSession, sf: str) -> DataFrame:
    objects = fleet.fleet_table(spark, sf, "objects").withColumnRenamed("created", "rotated_at")
    return traffic.rotation_due(objects, ["l_orderkey"], AS_OF)


def st1(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_windows(fleet.fleet_table(spark, sf, "drift_events")).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "env_id", "n",
    )


def st1_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of four files, counted in two starts of the same stream."""
    path = f"{shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    events = fleet.fleet_table(spark, sf, "drift_events")
    for low, high in ((0, 2), (2, 4)):
        part = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)).between(low, high - 1))
        part.repartition(2, F.xxhash64("event_id")).write.mode("append").parquet(f"{path}/events")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
        drift.start_drift_counts(stream, f"{path}/counts", f"{path}/state").awaitTermination()
    counted = checkpointed(drift.read_drift_counts(spark, f"{path}/counts"))
    remove_folder(spark, path)
    return counted.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "env_id", "n",
    )


# --- composed audits ---------------------------------------------------------------------


def fleet_name_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audits.name_summary(fleet.inventory(spark, sf), SETTINGS)


QUERIES = {
    "fleet_name_summary": fleet_name_summary,
    "s1_environment_registry": s1,
    "s1_changed_files": s1_files,
    "s2_layered_merge": s2,
    "s3_service_configs": s3,
    "s3_missing_documents": s3_missing,
    "s4_policy_documents": s4,
    "s5_stack_manifest": s5,
    "s6_findings_sink": s6,
    "s6_rerun_sink": s6_runs,
    "n1_resolve_context": n1,
    "n2_application_name": named(lambda: naming.application_name(type_code(), F.col("specific"))),
    "n3_shared_name": named(lambda: naming.shared_name(type_code(), F.col("specific"))),
    "n4_security_group_name": named(lambda: naming.security_group_name(type_code(), F.col("specific"))),
    "n5_bucket_name": named(lambda: naming.bucket_name(SETTINGS, F.col("specific"))),
    "n6_log_group_name": named(lambda: naming.log_group_name(type_code(), F.col("specific"))),
    "n6_shared_log_group_name": named(lambda: naming.shared_log_group_name(type_code(), F.col("specific"))),
    "n7_image_repository_name": named(lambda: naming.image_repository_name(SETTINGS, F.concat(F.lit("Repo-"), "specific"))),
    "n8_arn": n8,
    "n9_stack_name": n9,
    "n10_full_name_identifiers": n10,
    "n11_name_audit": n11,
    "n11_purposes": n11_purposes,
    "n12_name_limits": n12,
    "n13_name_collisions": n13,
    "n14_siblings": n14,
    "n15_environments_by_account": n15,
    "n16_register_codes": n16,
    "k1_containers": k1,
    "k1_ports": k1_ports,
    "k1_environment": k1_environment,
    "k1_secrets": k1_secrets,
    "k2_container_violations": k2,
    "k3_duplicate_names": k3,
    "k4_substitution": k4,
    "k5_tag_merge": k5,
    "k6_settings_merge": k6,
    "k7_container_environment": k7,
    "k8_settings_to_env": k8,
    "k9_override": k9,
    "k10_sizing_policy": k10_policy,
    "k10_sizing_effective": k10_effective,
    "k11_security_defaults": k11,
    "k12_retention": k12,
    "k12_retention_conflicts": k12_conflicts,
    "k13_container_port": k13,
    "k14_primary_container": k14,
    "k14_first_task": k14_first_task,
    "k15_port_mappings": k15,
    "k16_batch_jobs": k16,
    "k17_health_checks": k17,
    "k18_secret_names": k18,
    "k19_distinct_secrets": k19,
    "k20_secret_plan": k20,
    "k21_identity_secrets": k21,
    "k22_redirect_urls": k22,
    "q1_requirements": q1,
    "q2_role_checks": q2,
    "q3_summary": q3,
    "q3_levels": q3_levels,
    "q3_messages": q3_messages,
    "q4_all_valid": q4,
    "q4_errors": q4_errors,
    "q5_requirement_report": q5,
    "q6_last_results": q6,
    "q7_tag_violations": q7,
    "q8_endpoints": q8,
    "q9_existence": q9,
    "q10_drift": q10,
    "q10_range_drift": q10_ranges,
    "q10_document_drift": q10_documents,
    "q11_rule_differences": q11,
    "t1_unresolved_imports": t1,
    "t1_expected_imports": t1_expected,
    "t1_secret_exports": t1_secret_exports,
    "t2_duplicate_exports": t2,
    "t3_deploy_levels": t3,
    "t4_undeclared_dependencies": t4,
    "t5_list_imports": t5,
    "t5_list_exports": t5_join,
    "p1_statements": p1,
    "p2_policy_checks": p2,
    "p2_policy_checks_strict": p2_strict,
    "p3_evaluate": p3,
    "p4_conditions": p4,
    "p4_unsupported_conditions": p4_unsupported,
    "p5_isolation_rules": p5,
    "p6_trust_subjects": p6,
    "p6_trust_documents": p6_documents,
    "r1_routes": r1,
    "r1_many_routes": r1_many,
    "r2_health_states": r2,
    "r3_lifecycle": r3,
    "r4_dead_letters": r4,
    "r5_rotation_due": r5,
    "st1_drift_windows": st1,
    "st1_drift_stream": st1_stream,
}
