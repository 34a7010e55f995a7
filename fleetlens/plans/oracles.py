"""Checking SQL, written apart from the operators.

Each statement computes what the query of the same key returns, from the same tables, with
plain SQL. Operators whose result a single statement cannot express have none.
"""

from __future__ import annotations

from fleetlens.plans.catalog import AS_OF, SAMPLE_ROUTES, SAMPLE_STATEMENTS, SAMPLE_TRUST
from fleetlens.plans.fleet_tables import SAMPLE_KINDS, TABLES

# --- fixed values, written out again so that a wrong rule cannot agree with itself ---------

DOMAIN, ORGANISATION, WEB_HOST, LOG_SERVICE = "example.io", "example", "app.example.io", "web-app"
APPLICATIONS = [("AppOne", "one"), ("Cdk", "cdk")]
ENVIRONMENTS = [
    ("Development", "dev", "NonProduction"), ("Integration", "int", "NonProduction"),
    ("Staging", "stg", "Production"), ("Production", "prod", "Production"),
]
REGIONS = [("us-east-1", "ue1"), ("us-east-2", "ue2"), ("us-west-1", "uw1"), ("us-west-2", "uw2")]
SETTING_VALUES = [
    ("development", "EnableDetailedLogging", "True"), ("integration", "EnableDetailedLogging", "True"),
    ("staging", "EnableDetailedLogging", "False"), ("production", "EnableDetailedLogging", "False"),
    ("development", "EnableMockExternalServices", "True"), ("development", "UseLocalDatabase", "False"),
    ("development", "EnableDebugMode", "True"), ("development", "CacheEnabled", "False"),
    ("staging", "EnableMockExternalServices", "False"), ("staging", "UseProductionConfiguration", "True"),
    ("staging", "EnableStagingFeatures", "True"), ("staging", "CacheEnabled", "True"), ("staging", "EnableBlueGreenDeployment", "True"),
    ("production", "EnableMockExternalServices", "False"), ("production", "UseProductionConfiguration", "True"),
    ("production", "EnableHighAvailability", "True"), ("production", "CacheEnabled", "True"),
    ("production", "EnableDisasterRecovery", "True"), ("production", "EnableAdvancedMonitoring", "True"),
]
SIZE_COLUMNS = {
    "instance_type": "VARCHAR", "min_capacity": "INTEGER", "max_capacity": "INTEGER", "desired_capacity": "INTEGER",
    "database_class": "VARCHAR", "lambda_memory": "INTEGER", "task_cpu": "DOUBLE", "task_memory": "INTEGER",
    "cache_node": "VARCHAR", "search_instance": "VARCHAR", "high_availability": "BOOLEAN", "backup_days": "INTEGER",
}
SMALL = ("t3.small", 1, 2, 1, "db.t3.micro", 512, 0.5, 1024, "cache.t3.micro", "t3.small.search", False, 1)
MEDIUM = ("t3.medium", 1, 5, 2, "db.t3.small", 768, 1.0, 2048, "cache.t3.small", "t3.small.search", True, 7)
LARGE = ("t3.large", 2, 10, 4, "db.t3.medium", 1024, 2.0, 4096, "cache.t3.medium", "t3.medium.search", True, 30)
UNSET = ("t3.micro", 1, 3, 1, "db.t3.micro", 512, 0.5, 1024, "cache.t3.micro", "t3.small.search", False, 1)
POLICY_SIZES = [("Development", *SMALL), ("Integration", *SMALL), ("Staging", *MEDIUM), ("Production", *LARGE)]
EFFECTIVE_SIZES = [("development", *SMALL), ("integration", *SMALL), ("staging", *LARGE), ("production", *UNSET)]
GUIDE_DAYS = [("Development", 7), ("Integration", 14), ("Staging", 30), ("Production", 90)]
# imports that no stack exports, and who asks for them
NEVER_EXPORTED = [("provider", "sg-bastion-id")]
# purposes that resources, roles and buckets may have, as far as the sample kinds use them
KIND_PURPOSES = [
    ("ecs_cluster", "resource"), ("ecs_service", "resource"), ("rds_instance", "resource"), ("role", "iam"), ("sg_alb", "resource"),
    ("log_group", "resource"),
]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def with_tables(*parts: str) -> str:
    """``WITH`` over fleet tables (by name) and ready-made clauses."""
    return "WITH " + ",\n".join(f"{p} AS ({TABLES[p]})" if p in TABLES else p for p in parts) + "\n"


ENV = values("dim_env", "env_name, env_prefix, env_account_type", ENVIRONMENTS)
APP = values("dim_app", "app_name, app_code", APPLICATIONS)
REG = values("dim_region", "region, region_code", REGIONS)
KINDS = values("kinds", "kind_id, kind, specific, service", SAMPLE_KINDS)
DIMS = (ENV, APP, REG)

APP_NAME = (
    "CASE WHEN env_prefix IS NOT NULL AND app_code IS NOT NULL AND region_code IS NOT NULL "
    "THEN lower(concat_ws('-', env_prefix, app_code, {type}, region_code, {specific})) END"
)
SHARED_NAME = (
    "CASE WHEN env_prefix IS NOT NULL AND region_code IS NOT NULL "
    "THEN lower(concat_ws('-', env_prefix, 'shared', {type}, region_code, {specific})) END"
)
SG_NAME = (
    "CASE WHEN env_prefix IS NOT NULL AND app_code IS NOT NULL AND region_code IS NOT NULL "
    "THEN lower(concat_ws('-', env_prefix, app_code, 'sg', {type}, {specific}, region_code)) END"
)
BUCKET_NAME = (
    "CASE WHEN env_prefix IS NOT NULL AND app_code IS NOT NULL AND region_code IS NOT NULL "
    f"THEN lower(concat_ws('-', '{DOMAIN}', env_prefix, app_code, {{specific}}, region_code)) END"
)
LOG_NAME = (
    "CASE WHEN env_prefix IS NOT NULL AND app_code IS NOT NULL "
    "THEN '/aws/' || lower({type}) || '/' || env_prefix || '-' || app_code || '-' || lower({specific}) END"
)
SHARED_LOG = (
    "CASE WHEN env_prefix IS NOT NULL "
    "THEN '/aws/' || lower({type}) || '/' || env_prefix || '-shared-' || lower({specific}) END"
)

_EXPECTED = f"""CASE kind_id WHEN 0 THEN {APP_NAME.format(type="'ecs'", specific="'main'")}
  WHEN 1 THEN {APP_NAME.format(type="'svc'", specific="'web'")}
  WHEN 2 THEN {APP_NAME.format(type="'rds'", specific="'primary'")}
  WHEN 3 THEN {APP_NAME.format(type="'role'", specific="'ecs-task'")}
  WHEN 4 THEN {SHARED_NAME.format(type="'vpc'", specific="'main'")}
  WHEN 5 THEN {SG_NAME.format(type="'alb'", specific="'web'")}
  WHEN 6 THEN {BUCKET_NAME.format(specific="'docs'")}
  WHEN 7 THEN {LOG_NAME.format(type="'ecs'", specific="'api'")} END"""

RESOLVED = """resolved AS (SELECT f.*, env_prefix, env_account_type AS account_type, app_code, region_code,
    kind, specific, service, split_part(kind, '_', 1) AS type_code
  FROM fleet_resources f LEFT JOIN dim_env USING (env_name) LEFT JOIN dim_app USING (app_name)
  LEFT JOIN dim_region USING (region) JOIN kinds USING (kind_id))"""
EXPECTED = f"expected AS (SELECT *, {_EXPECTED} AS expected_name FROM resolved)"
INVENTORY = r"""inventory AS (SELECT *, CASE noise WHEN 0 THEN upper(expected_name) WHEN 7 THEN expected_name || '-x'
    WHEN 3 THEN CASE kind_id WHEN 6 THEN regexp_replace(expected_name, '-(dev|int|stg|prod)-', '-dev-')
                WHEN 7 THEN regexp_replace(expected_name, '/(dev|int|stg|prod)-', '/dev-')
                ELSE regexp_replace(expected_name, '^(dev|int|stg|prod)-', 'dev-') END
    ELSE expected_name END AS observed_name FROM expected)"""

NAMES = with_tables("fleet_resources", *DIMS, KINDS, RESOLVED, EXPECTED, INVENTORY)
RES = "l_orderkey, l_linenumber"


def _named(expression: str) -> str:
    return f"{NAMES} SELECT {RES}, {expression} AS resource_name FROM resolved"


ORACLES: dict[str, str] = {}

ORACLES["fleet_name_summary"] = f"""{NAMES}
SELECT env_name, kind, count(*) AS total, count(*) FILTER (WHERE lower(observed_name) = lower(expected_name)) AS valid,
  count(*) FILTER (WHERE lower(observed_name) <> lower(expected_name)) AS invalid,
  count(*) FILTER (WHERE expected_name IS NULL) AS no_context
FROM inventory GROUP BY env_name, kind"""

# --- sources -----------------------------------------------------------------------------

ORACLES["s1_environment_registry"] = f"""WITH base AS (SELECT o_orderkey, o_custkey, o_orderpriority,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Development' WHEN 1 THEN 'Integration' WHEN 2 THEN 'Staging'
    WHEN 3 THEN 'Production' ELSE 'Sandbox' END AS env_name FROM orders), {ENV}
SELECT o_orderkey AS registry_id, env_name,
  CASE WHEN o_orderkey % 7 <> 0 THEN '10000000000' || CAST(o_custkey % 4 AS VARCHAR) END AS account_id,
  CASE WHEN o_custkey % 3 = 1 THEN 'Production' ELSE env_account_type END AS account_type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'us-east-1' WHEN o_orderkey % 11 = 3 THEN 'eu-west-1' ELSE 'us-west-2' END AS region,
  'Owner=' || o_orderpriority || ';region=r;tags=t' AS tags,
  CASE WHEN o_orderkey % 7 = 0 THEN 'AccountId is required' WHEN env_name = 'Sandbox' AND o_custkey % 3 <> 1 THEN 'Unknown environment: Sandbox'
    WHEN o_orderkey % 4 <> 0 AND o_orderkey % 11 = 3 THEN 'Unsupported region ''eu-west-1'' in environment ''' || env_name || '''' END AS error
FROM base LEFT JOIN dim_env USING (env_name)"""

ORACLES["s1_changed_files"] = """WITH runs AS (
  SELECT 1 AS run, s_suppkey, s_nationkey, 'new' AS change FROM supplier WHERE s_suppkey % 4 <> 1
  UNION ALL SELECT 2, s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 3 THEN 'removed' WHEN s_suppkey % 4 = 1 THEN 'new' ELSE 'changed' END FROM supplier
  WHERE CASE WHEN s_suppkey % 7 = 3 THEN s_suppkey % 4 <> 1 ELSE s_suppkey % 4 = 1 OR s_suppkey % 5 = 0 END),
read AS (SELECT *, change <> 'removed' AND s_suppkey % 11 <> 6 AND s_suppkey % 13 <> 5 AS good FROM runs)
SELECT run, s_suppkey AS doc, change,
  CASE WHEN good THEN CASE s_suppkey % 5 WHEN 0 THEN 'Development' WHEN 1 THEN 'Integration' WHEN 2 THEN 'Staging' WHEN 3 THEN 'Production' ELSE 'Sandbox' END END AS env_name,
  CASE WHEN good THEN CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey * 10 + run ELSE s_nationkey END AS VARCHAR) END AS account_id,
  CASE WHEN change <> 'removed' AND NOT good THEN 'no environment found' WHEN good AND s_suppkey % 5 = 4 THEN 'Unknown environment: Sandbox' END AS error
FROM read"""
ORACLES["s2_layered_merge"] = f"""{with_tables("layers")}
SELECT scope, key, value FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY priority DESC) AS rn FROM layers)
WHERE rn = 1"""

_DOC_CASE = "CAST((l_partkey + l_linenumber) % 10 AS INT)"
_DOC_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_ENV_OF = (
    "CASE CAST({k} % 5 AS INT) WHEN 0 THEN 'Development' WHEN 1 THEN 'Integration' WHEN 2 THEN 'Staging' "
    "WHEN 3 THEN 'Production' ELSE 'Sandbox' END"
)
DOCS = f"""docs AS (SELECT c.*, {_DOC_ID} AS text_id, {_DOC_CASE} AS doc_case, row_number() OVER () AS rid
  FROM container_rows c)"""
DOC_CONTAINERS = """doc_containers AS (
  SELECT rid, text_id, 0 AS task_no, 'main' AS task, 0 AS pos, name, image, essential, ports_case, protocol, secret_var AS secret FROM docs WHERE doc_case >= 3
  UNION ALL SELECT rid, text_id, 0, 'main', 1, 'web', 'repo/side:1', NULL, 9, 'tcp', NULL FROM docs WHERE doc_case >= 3
  UNION ALL SELECT rid, text_id, 0, ' ', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM docs WHERE doc_case = 2
  UNION ALL SELECT rid, text_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM docs WHERE doc_case < 2)"""
PORT_ROWS = values("port_rows", "ports_case, port_no, container_port", [(2, 0, 8080), (3, 0, 80), (3, 1, 8080), (4, 0, 70000), (9, 0, 8443)])
DOC_BASE = with_tables("container_rows", DOCS, DOC_CONTAINERS, PORT_ROWS)

ORACLES["s3_service_configs"] = f"""{DOC_BASE}
SELECT text_id AS doc_id, env_name, CASE WHEN doc_case = 0 THEN 'Invalid ECS configuration format' END AS error,
  CASE WHEN doc_case = 0 THEN 'dev' END AS vpc_name_pattern, CASE WHEN doc_case >= 3 THEN 'a,]' END AS service_name,
  CAST(CASE WHEN doc_case = 0 THEN NULL WHEN doc_case = 1 THEN 0 ELSE 1 END AS INTEGER) AS n_tasks,
  CAST(CASE WHEN doc_case < 2 THEN NULL WHEN doc_case = 2 THEN 0 ELSE 2 END AS INTEGER) AS n_containers
FROM docs"""

_OIDC = "StringEquals|token:aud|sts.amazonaws.com,StringLike|token:sub|repo:org/app:ref:refs/heads/feature/*/repo:org/app:pull_request"
# case, number, sid, effect, actions, resources, not actions, not resources, principal, conditions, error
_POLICY_STATEMENTS = [
    (0, 0, "A", "Allow", "s3:*", "*", None, None, None, None, None),
    (1, 0, "B", "Allow", "secretsmanager:GetSecretValue,kms:Decrypt", "/dev/*", None, None, None, None, None),
    (2, 0, "C", "Deny", "secretsmanager:GetSecretValue", "*", None, None, None, None, None),
    (2, 1, "D", "Allow", "kms:Decrypt", "/dev/a,/stg/b", None, None, None, None, None),
    (3, 0, "E", "Allow", "sts:AssumeRole", "*", None, None, '{"Service":"ecs"}', "StringLike|k|a*/b", None),
    (4, None, None, None, None, None, None, None, None, None, None),
    (5, 0, "F", "Allow", "sts:AssumeRole", None, None, None, '{"Service":"ecs"}', None, None),
    (6, 0, "G", "Deny", None, "*", "s3:*", None, None, "StringNotEquals|k|v", None),
    (6, 1, "H", "Allow", "s3:Get*", None, None, "/dev/*,/stg/*", None, None, None),
    (7, None, None, None, None, None, None, None, None, None, "document does not parse"),
    (8, 0, "T", "Allow", "sts:AssumeRoleWithWebIdentity", None, None, None, '{"Federated":"oidc"}', _OIDC, None),
]
_POLICY_CASE = "CASE WHEN o_orderkey % 1000 = 5 THEN 8 ELSE o_orderkey % 8 END"
POLICY_ROWS = values(
    "p", "case_no, statement_no, sid, effect, actions, resources, not_actions, not_resources, principal, conditions, error", _POLICY_STATEMENTS
)
ORACLES["s4_policy_documents"] = f"""WITH {POLICY_ROWS}
SELECT o_orderkey AS policy_id, CAST(statement_no AS INTEGER) AS statement_no, sid, effect, actions, resources, not_actions, not_resources,
  principal, conditions, error
FROM orders JOIN p ON {_POLICY_CASE} = case_no"""

ORACLES["s3_missing_documents"] = f"""{DOC_BASE}, contexts AS ({TABLES['contexts']})
SELECT context_id, env_name FROM contexts WHERE context_id NOT IN (SELECT l_orderkey FROM docs WHERE doc_case <> 0)"""

ORACLES["s5_stack_manifest"] = """
SELECT p_partkey AS manifest_id, 'node' AS part, 'S' || p_partkey AS stack, 'alb:' || p_size AS value FROM part
UNION ALL SELECT p_partkey, 'node', 'T', 'ecs' FROM part
UNION ALL SELECT p_partkey, 'deps', 'S' || p_partkey, 'S' || (p_partkey // 2) FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'exports', 'S' || p_partkey, p_brand FROM part
UNION ALL SELECT p_partkey, 'exports', 'S' || p_partkey, 'alb-arn' FROM part
UNION ALL SELECT p_partkey, 'imports', 'T', 'alb-arn' FROM part"""

ORACLES["s6_findings_sink"] = f"""{NAMES}
SELECT {RES}, env_name, kind, observed_name, expected_name FROM inventory WHERE lower(observed_name) <> lower(expected_name)"""

ORACLES["s6_rerun_sink"] = f"""{NAMES}, found AS (SELECT {RES}, env_name, kind, observed_name, expected_name FROM inventory WHERE lower(observed_name) <> lower(expected_name))
SELECT *, 'first' AS run FROM found WHERE kind = 'Storage' OR env_name = 'Production' UNION ALL SELECT *, 'second' FROM found WHERE env_name = 'Development'"""

# --- names -------------------------------------------------------------------------------

ORACLES["n1_resolve_context"] = f"""{NAMES}
SELECT {RES}, env_name, app_name, region, env_prefix, account_type, app_code, region_code,
  CASE WHEN env_prefix IS NULL THEN 'Unknown environment: ' || env_name ELSE '' END AS errors
FROM resolved"""
ORACLES["n2_application_name"] = _named(APP_NAME.format(type="type_code", specific="specific"))
ORACLES["n3_shared_name"] = _named(SHARED_NAME.format(type="type_code", specific="specific"))
ORACLES["n4_security_group_name"] = _named(SG_NAME.format(type="type_code", specific="specific"))
ORACLES["n5_bucket_name"] = _named(BUCKET_NAME.format(specific="specific"))
ORACLES["n6_log_group_name"] = _named(LOG_NAME.format(type="type_code", specific="specific"))
ORACLES["n6_shared_log_group_name"] = _named(SHARED_LOG.format(type="type_code", specific="specific"))
ORACLES["n7_image_repository_name"] = _named(f"'{ORGANISATION}/' || lower(app_name) || '/Repo-' || specific")

_ARN_KIND = "CASE kind_id % 3 WHEN 0 THEN 'role' WHEN 1 THEN 'policy' ELSE 'user' END"
ORACLES["n8_arn"] = f"""{NAMES}, a AS (SELECT *, '10000000000' || (l_orderkey % 4) AS account_id, {_ARN_KIND} AS arn_kind,
  CASE kind_id WHEN 3 THEN 's3' WHEN 4 THEN 'sqs' WHEN 5 THEN 'sns' WHEN 7 THEN 's3' ELSE 'iam' END AS arn_service FROM resolved),
b AS (SELECT *, {APP_NAME.format(type="arn_kind", specific="'main'")} AS own_name, {BUCKET_NAME.format(specific="'docs'")} AS bucket FROM a)
SELECT {RES}, arn_service AS service, CASE arn_service WHEN 'iam' THEN 'arn:aws:iam::' || account_id || ':' || arn_kind || '/' || own_name
  WHEN 's3' THEN 'arn:aws:s3:::' || bucket ELSE 'arn:aws:' || arn_service || ':' || region || ':' || account_id || ':' || own_name END AS arn
FROM b"""

ORACLES["n9_stack_name"] = f"""{NAMES}, a AS (SELECT *, CASE kind_id WHEN 0 THEN 'app' WHEN 1 THEN 'base' WHEN 2 THEN 'ALB' WHEN 3 THEN 'ecs'
  WHEN 4 THEN 'Data' WHEN 5 THEN 'COGNITO' WHEN 6 THEN 'other' ELSE 'app' END AS stack FROM resolved)
SELECT {RES}, stack, env_prefix || '-' || CASE stack WHEN 'app' THEN app_code || '-stack' WHEN 'base' THEN 'shared-stack'
  WHEN 'other' THEN NULL ELSE app_code || '-' || lower(stack) END || '-' || region_code AS stack_name FROM a"""

ORACLES["n10_full_name_identifiers"] = f"""{NAMES}
SELECT {RES}, env_name || '-' || app_name || '-alb-arn' AS app_export, env_name || '-vpc-id' AS env_export,
  '/' || lower(env_name) || '/' || lower(app_name) || '/' || kind AS secret_path,
  env_name || '-' || lower(app_name) || '-task-role' AS task_role, lower(env_name) || '-' || lower(app_name) || '-auth' AS auth_domain
FROM resolved"""

ORACLES["n11_name_audit"] = f"""{NAMES}
SELECT {RES}, kind, observed_name, expected_name, lower(observed_name) = lower(expected_name) AS is_valid FROM inventory"""

_FAMILIES = values("kind_families", "kind, expected_family", KIND_PURPOSES)
ORACLES["n11_purposes"] = f"""{NAMES}, {_FAMILIES}
SELECT {RES}, kind, 'uploads' AS specific, expected_family FROM inventory JOIN kind_families USING (kind) WHERE noise = 5"""

ORACLES["n12_name_limits"] = f"""{NAMES}, padded AS (SELECT {RES}, kind, observed_name || repeat('-long', l_linenumber) AS name FROM inventory),
checked AS (SELECT *, CASE WHEN kind IN ('bucket', 'rds_instance') AND length(name) > 63 THEN 'too long: ' || length(name) || ' chars, max 63'
    WHEN kind = 'ecs_cluster' AND length(name) > 255 THEN 'too long: ' || length(name) || ' chars, max 255' END AS long,
  CASE WHEN kind = 'bucket' AND NOT regexp_full_match(name, '[a-z0-9.-]+') THEN 'characters not allowed' END AS bad
  FROM padded WHERE name IS NOT NULL)
SELECT {RES}, kind, name, concat_ws(',', long, bad) AS problems FROM checked WHERE long IS NOT NULL OR bad IS NOT NULL"""

ORACLES["n13_name_collisions"] = f"""{NAMES}
SELECT account_type, lower(observed_name) AS lower_name, string_agg(DISTINCT env_name, ',' ORDER BY env_name) AS environments
FROM inventory WHERE observed_name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT env_name) > 1"""

ORACLES["n14_siblings"] = f"""{with_tables("contexts")}
SELECT 'account_type' AS grouped_by, account_type AS account, string_agg(DISTINCT env_name, ',' ORDER BY env_name) AS siblings FROM contexts GROUP BY 2
UNION ALL SELECT 'account_id', account_id, string_agg(DISTINCT env_name, ',' ORDER BY env_name) FROM contexts GROUP BY 2"""

ORACLES["n15_environments_by_account"] = f"""{with_tables("contexts")}
SELECT CASE WHEN context_id % 11 = 0 THEN 'Unknown' ELSE account_id END AS account_id,
  CASE WHEN version = 'vO' THEN 'NonProduction' ELSE account_type END AS account_type,
  string_agg(DISTINCT env_name, ',' ORDER BY env_name) AS environments, count(*) AS n_rows
FROM contexts WHERE version <> 'vP' GROUP BY 1, 2"""

ORACLES["n16_register_codes"] = """WITH dim(app_name, app_code) AS (VALUES ('AppOne', 'one'), ('Cdk', 'cdk'), ('Taken', 'n7'), ('Other', 'n11')),
new_rows AS (SELECT s_name AS app_name, 'n' || s_nationkey AS app_code, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier
  UNION ALL SELECT s_name || '-tie', 't' || s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name || '-tie') FROM supplier)
SELECT app_name, app_code, 'registered' AS outcome FROM dim
UNION ALL SELECT app_name, app_code, CASE WHEN rn = 1 AND app_code NOT IN (SELECT app_code FROM dim) THEN 'registered' ELSE 'code already in use' END FROM new_rows
UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name || '-half' END, CASE WHEN s_suppkey % 2 = 1 THEN 'half' END, 
  CASE WHEN s_suppkey % 2 = 0 THEN 'code is missing' ELSE 'key is missing' END FROM supplier"""

# --- configuration -----------------------------------------------------------------------

ORACLES["k1_containers"] = f"""{DOC_BASE}
SELECT text_id AS doc_id, CAST(task_no AS INTEGER) AS task_no, task, CAST(pos AS INTEGER) AS pos, name, image, essential,
  CAST(CASE ports_case WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 3 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 9 THEN 1 END AS INTEGER) AS n_ports,
  secret AS secrets FROM doc_containers"""
ORACLES["k1_ports"] = f"""{DOC_BASE}
SELECT text_id AS doc_id, CAST(pos AS INTEGER) AS pos, CAST(port_no AS INTEGER) AS port_no, CAST(container_port AS INTEGER) AS container_port,
  CASE WHEN port_no IS NOT NULL THEN protocol END AS protocol
FROM doc_containers LEFT JOIN port_rows USING (ports_case)"""
ORACLES["k1_secrets"] = f"""{DOC_BASE}
SELECT text_id AS doc_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN secret IS NOT NULL THEN 0 END AS INTEGER) AS secret_no, secret FROM doc_containers"""

ENV_ROWS = values(
    "env_rows", "env_case, var_no, var, value",
    [
        (0, None, None, None), (1, 0, "NIGHTLY_CRON", "0 * * * *"), (2, 0, "health_check_path", "status"), (2, 1, "PORT", "9090"),
        (3, 0, "A", ""), (3, 1, "ENVIRONMENT", "Mine"), (3, 2, "ENVIRONMENT", "Last"), (3, 3, None, "x"),
    ],
)
ORACLES["k1_environment"] = f"""{with_tables("container_rows", ENV_ROWS)}
SELECT {RES}, name, CAST(var_no AS INTEGER) AS var_no, var, value FROM container_rows JOIN env_rows USING (env_case)"""

_HEAD = "'Container ''' || name || ''' "
ORACLES["k2_container_violations"] = f"""{DOC_BASE}, found AS (
  SELECT rid, text_id, NULL AS task_no, NULL AS pos, 0 AS ord, 'task_required' AS rule, 'At least one TaskDefinition configuration is required' AS message FROM docs WHERE doc_case < 2
  UNION ALL SELECT rid, text_id, 0, NULL, 0, 'task_name_required', 'TaskDefinitionName is required in the configuration' FROM docs WHERE doc_case = 2
  UNION ALL SELECT rid, text_id, 0, pos, 1, 'name_required', 'Container name is required' FROM doc_containers WHERE name = ''
  UNION ALL SELECT rid, text_id, 0, pos, 2, 'image_required', {_HEAD}requires an image' FROM doc_containers WHERE pos IS NOT NULL AND (image IS NULL OR image = '')
  UNION ALL SELECT rid, text_id, 0, pos, 10 + port_no * 10, 'port_range', {_HEAD}has invalid port mapping: ContainerPort must be <= 65535'
    FROM doc_containers JOIN port_rows USING (ports_case) WHERE container_port > 65535
  UNION ALL SELECT rid, text_id, 0, pos, 11 + port_no * 10, 'protocol_required', {_HEAD}has invalid port mapping: Protocol is required'
    FROM doc_containers JOIN port_rows USING (ports_case) WHERE protocol IS NULL
  UNION ALL SELECT rid, text_id, 0, pos, 12 + port_no * 10, 'protocol_known', {_HEAD}has invalid port mapping: Protocol must be ''tcp'' or ''udp'', got ''' || protocol || ''''
    FROM doc_containers JOIN port_rows USING (ports_case) WHERE protocol = 'Tcp')
SELECT text_id AS doc_id, CAST(task_no AS INTEGER) AS task_no, CAST(pos AS INTEGER) AS pos, rule, message,
  row_number() OVER (PARTITION BY rid ORDER BY pos, ord) = 1 AS first FROM found"""

ORACLES["k3_duplicate_names"] = f"""{with_tables("container_rows")}
SELECT doc_id, name, count(*) AS n FROM container_rows WHERE name <> '' GROUP BY doc_id, name HAVING count(*) > 1"""

CONTEXTS = with_tables(
    "contexts", *DIMS,
    "c AS (SELECT contexts.*, env_prefix, app_code, region_code FROM contexts LEFT JOIN dim_env USING (env_name) LEFT JOIN dim_app USING (app_name) LEFT JOIN dim_region USING (region))",
)
ORACLES["k4_substitution"] = f"""{CONTEXTS}
SELECT context_id, CASE WHEN context_id % 3 = 0 THEN 'plain $ENVIRONMENT {{x}}' ELSE env_name || '/' || account_type || '/' || version || '/' || region || '/'
  || coalesce({APP_NAME.format(type="'svc'", specific="'web'")}, '') || '/' || coalesce({APP_NAME.format(type="'task'", specific="'web'")}, '') || '/'
  || coalesce({LOG_NAME.format(type=f"'{LOG_SERVICE}'", specific="'web'")}, '') || '/' || env_name
  || '/${{TASK_ROLE_ARN}}/${{CERTIFICATE_ARN}}/${{TASK_ROLE_ARN}}' END AS text,
  CASE WHEN context_id % 3 = 0 THEN '' ELSE 'TASK_ROLE_ARN,CERTIFICATE_ARN' END AS unresolved
FROM c"""

ORACLES["k5_tag_merge"] = f"""{with_tables("contexts")}, layers AS (
  SELECT context_id, 0 AS layer, 'Environment' AS tag, 'OverrideValue' AS value FROM contexts WHERE context_id % 4 <> 0
  UNION ALL SELECT context_id, 0, 'Owner', priority FROM contexts WHERE context_id % 4 <> 0
  UNION ALL SELECT context_id, 0, 'StackType', 'mine' FROM contexts WHERE context_id % 4 <> 0
  UNION ALL SELECT context_id, 1, 'Environment', env_name FROM contexts
  UNION ALL SELECT context_id, 1, 'Application', app_name FROM contexts
  UNION ALL SELECT context_id, 1, 'Version', CASE WHEN context_id % 3 = 0 THEN 'local' ELSE left('abcdef' || context_id || 'xyz', 8) END FROM contexts
  UNION ALL SELECT context_id, 1, 'DeploymentId', 'd' || context_id FROM contexts
  UNION ALL SELECT context_id, 1, 'DeployedAt', strftime(deployed_at, '%Y-%m-%d') FROM contexts
  UNION ALL SELECT context_id, 2, 'StackType', 'EnvironmentBase' FROM contexts WHERE context_id % 2 = 0
  UNION ALL SELECT context_id, 2, 'Shared', 'true' FROM contexts WHERE context_id % 2 = 0
  UNION ALL SELECT context_id, 2, 'Purpose', 'SharedInfrastructure' FROM contexts WHERE context_id % 2 = 0
  UNION ALL SELECT context_id, 2, 'AccountType', account_type FROM contexts WHERE context_id % 2 <> 0)
SELECT context_id, tag, arg_max(value, layer) AS value FROM layers GROUP BY context_id, tag"""

SETTING_ROWS = values("setting_rows", "env, key, value", SETTING_VALUES)
ORACLES["k6_settings_merge"] = f"""{with_tables("contexts", SETTING_ROWS)}
SELECT context_id, key, value FROM contexts JOIN setting_rows ON env = lower(env_name)"""
ORACLES["k8_settings_to_env"] = f"""{with_tables("contexts", SETTING_ROWS)}
SELECT context_id, 'APP_' || upper(key) AS variable, value FROM contexts JOIN setting_rows ON env = lower(env_name)"""

_PLACEHOLDER = "(image IS NULL OR image = '' OR image = 'placeholder')"
ORACLES["k7_container_environment"] = f"""WITH rows AS (SELECT l_orderkey, l_linenumber, name, image, env_case FROM ({TABLES['container_rows']})),
contexts AS (SELECT * FROM ({TABLES['contexts']}) WHERE version <> 'vP')
SELECT {RES}, name, image, CASE WHEN context_id IS NULL THEN 'no context for the document' END AS error, 'ACCOUNT_TYPE=' || account_type || CASE WHEN {_PLACEHOLDER} THEN ';APP_NAME=' || app_name ELSE '' END
  || ';APP_VERSION=1.0.0;AWS_ACCOUNT_ID=' || account_id || ';AWS_REGION=' || region
  || CASE WHEN {_PLACEHOLDER} THEN ';DEPLOYMENT_TYPE=placeholder;ENVIRONMENT=' || env_name || ';HEALTH_CHECK_PATH=/health;MANAGED_BY=CDK;PORT=8080'
     WHEN env_case = 1 THEN ';ENVIRONMENT=' || env_name || ';HEALTH_CHECK_PATH=/health;NIGHTLY_CRON=0 * * * *;PORT=8080'
     WHEN env_case = 2 THEN ';ENVIRONMENT=' || env_name || ';HEALTH_CHECK_PATH=/health;PORT=9090;health_check_path=status'
     WHEN env_case = 3 THEN ';ENVIRONMENT=Last;HEALTH_CHECK_PATH=/health;PORT=8080'
     ELSE ';ENVIRONMENT=' || env_name || ';HEALTH_CHECK_PATH=/health;PORT=8080' END AS env_vars
FROM rows LEFT JOIN contexts ON l_orderkey = context_id"""

ORACLES["k9_override"] = f"""{with_tables("contexts")}
SELECT context_id, env_name, env_name IN ('Staging', 'Production') AS enhanced_monitoring,
  CAST(CASE env_name WHEN 'Development' THEN 1 WHEN 'Production' THEN 30 ELSE 7 END AS INTEGER) AS backup_days FROM contexts"""


def _sizing(rows: list[tuple], join: str) -> str:
    table = values("sizes", "size_env, " + ", ".join(SIZE_COLUMNS), rows)
    columns = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in SIZE_COLUMNS.items())
    return f"""{with_tables("contexts", table)}
SELECT context_id, env_name, {columns}, CAST(task_cpu * 1024 AS INTEGER) AS cpu_units,
  CAST(CASE WHEN high_availability THEN 3 WHEN NOT high_availability THEN 2 END AS INTEGER) AS zones, high_availability AS deletion_protection
FROM contexts LEFT JOIN sizes ON size_env = {join}"""


ORACLES["k10_sizing_policy"] = _sizing(POLICY_SIZES, "CASE WHEN env_name = 'Sandbox' THEN 'Development' ELSE env_name END")
ORACLES["k10_sizing_effective"] = _sizing(EFFECTIVE_SIZES, "lower(env_name)")

ORACLES["k11_security_defaults"] = f"""{with_tables("contexts")}
SELECT context_id, account_type, account_type = 'Production' AS enable_waf,
  CASE WHEN account_type = 'Production' THEN '' ELSE '10.0.0.0/8' END AS allowed_cidrs FROM contexts"""

_RETENTION = """retained AS (
  SELECT context_id, env_name, 'app_logs' AS subject, 'code' AS rule, CASE account_type WHEN 'Production' THEN 30 WHEN 'NonProduction' THEN 7 ELSE 3 END AS days FROM contexts
  UNION ALL SELECT context_id, env_name, 'shared_logs', 'code', CASE WHEN account_type = 'Production' THEN 30 ELSE 7 END FROM contexts
  UNION ALL SELECT context_id, env_name, 'backups', 'sizing', CASE env_name WHEN 'Production' THEN 30 WHEN 'Staging' THEN 7 ELSE 1 END FROM contexts
  UNION ALL SELECT context_id, env_name, 'backups', 'override', CASE env_name WHEN 'Production' THEN 30 WHEN 'Development' THEN 1 ELSE 7 END FROM contexts
  UNION ALL SELECT context_id, env_name, 'shared_database', 'code', 7 FROM contexts)"""
ORACLES["k12_retention"] = f"""{with_tables("contexts", _RETENTION)}
SELECT context_id, env_name, subject, rule, CAST(days AS INTEGER) AS days FROM retained"""
ORACLES["k12_retention_conflicts"] = f"""{with_tables("contexts", _RETENTION, values("guide", "env_name, days", GUIDE_DAYS))}
, everything AS (SELECT env_name, subject, days FROM retained
  UNION ALL SELECT env_name, 'app_logs', guide.days FROM contexts JOIN guide USING (env_name))
SELECT env_name, subject, string_agg(CAST(days AS VARCHAR), ',' ORDER BY days) AS days
FROM (SELECT DISTINCT env_name, subject, days FROM everything) GROUP BY 1, 2 HAVING count(*) > 1"""

CONTAINERS = with_tables("container_rows", PORT_ROWS)
_PORT = "CASE ports_case WHEN 2 THEN 8080 WHEN 3 THEN 8080 WHEN 4 THEN 70000 END"
ORACLES["k13_container_port"] = f"""{CONTAINERS} SELECT {RES}, name, CAST({_PORT} AS INTEGER) AS port FROM container_rows"""

_LIST_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
ORACLES["k14_primary_container"] = f"""{CONTAINERS},
r AS (SELECT doc_id, name, {_PORT} AS port, row_number() OVER (PARTITION BY doc_id ORDER BY {_LIST_ORDER}) AS pos FROM container_rows),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN port IS NULL THEN 1 ELSE 0 END, pos) AS rn FROM r)
SELECT doc_id, name AS primary_name, CAST(coalesce(port, 0) AS INTEGER) AS primary_port FROM best WHERE rn = 1"""

ORACLES["k14_first_task"] = f"""{DOC_BASE},
ported AS (SELECT rid, text_id, name, pos, CASE ports_case WHEN 2 THEN 8080 WHEN 3 THEN 8080 WHEN 4 THEN 70000 WHEN 9 THEN 8443 END AS port
  FROM doc_containers WHERE task_no = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY CASE WHEN port IS NULL THEN 1 ELSE 0 END, pos, port) AS rn FROM ported)
SELECT text_id AS doc_id, CASE WHEN pos IS NULL THEN 'app' ELSE name END AS primary_name,
  CAST(CASE WHEN pos IS NULL THEN 8080 ELSE coalesce(port, 0) END AS INTEGER) AS primary_port FROM best WHERE rn = 1"""

ORACLES["k15_port_mappings"] = f"""{CONTAINERS}
SELECT {RES}, name, name || '-' || container_port || '-' || lower(protocol) AS mapping_name, CAST(container_port AS INTEGER) AS container_port,
  CAST(CASE WHEN ports_case = 4 THEN 0 WHEN container_port = 80 THEN NULL ELSE 8080 END AS INTEGER) AS host_port, lower(protocol) AS protocol,
  CASE WHEN container_port = 80 THEN 'grpc' ELSE 'http' END AS app_protocol
FROM container_rows JOIN port_rows USING (ports_case) WHERE protocol IS NOT NULL"""

_BATCH = "(name IN ('Cron-Report', 'sync-worker') OR ports_case = 1 OR env_case = 1 OR coalesce(NOT essential, FALSE))"
ORACLES["k16_batch_jobs"] = f"""{CONTAINERS} SELECT {RES}, name, {_BATCH} AS is_batch_job FROM container_rows"""

_OFF = f"(health_off OR {_BATCH})"
ORACLES["k17_health_checks"] = f"""{CONTAINERS}
SELECT {RES}, name, CASE WHEN {_OFF} THEN 'none' WHEN health_case IN (1, 4) THEN 'custom' ELSE 'standard' END AS kind,
  CASE WHEN {_OFF} THEN NULL WHEN health_case = 1 THEN 'CMD-SHELL curl http://localhost:8080/ready || exit 1' WHEN health_case = 4 THEN 'CMD true'
    ELSE 'CMD-SHELL wget --no-verbose --tries=1 --spider http://localhost:8080'
      || CASE WHEN health_case = 2 THEN '/off' WHEN health_case = 3 THEN '/health' WHEN env_case = 2 THEN '/status' ELSE '/health' END || ' || exit 1' END AS command,
  CAST(CASE WHEN {_OFF} THEN NULL WHEN health_case = 1 THEN 10 ELSE 30 END AS INTEGER) AS interval,
  CAST(CASE WHEN {_OFF} THEN NULL WHEN health_case = 4 THEN 7 ELSE 5 END AS INTEGER) AS timeout,
  CAST(CASE WHEN {_OFF} THEN NULL WHEN health_case = 4 THEN 9 ELSE 3 END AS INTEGER) AS retries,
  CAST(CASE WHEN {_OFF} THEN NULL WHEN health_case = 1 THEN 5 ELSE 60 END AS INTEGER) AS start_period
FROM container_rows"""

_SECRETS = with_tables(
    "secret_requests",
    "named AS (SELECT l_orderkey, request_no, env_name, app_name, variable, replace(lower(variable), '__', '-') AS secret_name, '/' || lower(env_name) || '/appone/' || replace(lower(variable), '__', '-') AS path FROM secret_requests)",
)
ORACLES["k18_secret_names"] = f"{_SECRETS} SELECT l_orderkey, variable, secret_name, path FROM named"
ORACLES["k19_distinct_secrets"] = f"""{with_tables("container_rows")}
SELECT DISTINCT doc_id, secret_var AS secret FROM container_rows UNION SELECT DISTINCT doc_id, 'test-secret' FROM container_rows"""
ORACLES["k20_secret_plan"] = f"""{_SECRETS}, existing AS ({TABLES['existing_secrets']})
SELECT path, CASE WHEN path IN (SELECT path FROM existing WHERE lookup_ok) THEN 'import' ELSE 'create' END AS action, first(variable ORDER BY request_no, variable) AS served_variable,
  string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables, count(*) AS n_requests, count(DISTINCT variable) > 1 AS is_collision
FROM named GROUP BY path"""
ORACLES["t1_secret_exports"] = f"""{_SECRETS}
SELECT DISTINCT env_name, app_name, secret_name, env_name || '-' || app_name || '-' || secret_name || '-secret-arn' AS name FROM named"""
ORACLES["k21_identity_secrets"] = f"""{with_tables("container_rows")}
SELECT {RES}, CASE secret_var WHEN 'Cognito__Domain' THEN 'cognito-domain' ELSE 'openaioptions-apikey' END AS secret_name,
  secret_var = 'Cognito__Domain' AS is_identity FROM container_rows"""

_URLS = []
for _env, _prefix in [("production", ""), ("staging", "stg-"), ("development", "dev-"), ("integration", "int-"), (None, None)]:
    _hosts = [] if _prefix is None else [f"https://{_prefix}{WEB_HOST}"]
    if _env not in ("production", "staging"):
        _hosts += ["https://localhost:7015", "https://localhost:7243"]
    _URLS += [(_env, "callback", i, h + "/signin-oidc") for i, h in enumerate(_hosts)]
    _URLS += [(_env, "logout", i, u) for i, u in enumerate(u for h in _hosts for u in (h, h + "/logout"))]
ORACLES["k22_redirect_urls"] = f"""{with_tables("contexts", values("urls", "env, purpose, pos, url", _URLS))}
SELECT context_id, purpose, CAST(pos AS INTEGER) AS pos, url, TRUE AS is_https
FROM contexts JOIN urls ON coalesce(env, 'sandbox') = lower(env_name)"""

# --- requirements ------------------------------------------------------------------------

_ROLE_RULES = [
    ("EcsTask", "ecs-task", "CanAssumeEcsTasks,HasS3Access", None),
    ("EcsExecution", "ecs-exec", "CanAssumeEcsTasks,HasEcsExecutionPolicy", None),
    ("S3Access", "s3-access", "HasS3Access", "Production"),
]
REQUIRED = [
    "contexts", *DIMS, values("role_rules", "purpose, text, rules, only_type", _ROLE_RULES),
    f"""needed AS (SELECT c.*, r.*, {APP_NAME.format(type="'role'", specific="r.text")} AS expected_name
  FROM (SELECT * REPLACE (CASE WHEN context_id % 23 <> 0 THEN account_type END AS account_type) FROM contexts) c LEFT JOIN dim_env USING (env_name) LEFT JOIN dim_app USING (app_name) LEFT JOIN dim_region USING (region)
  JOIN role_rules r ON r.only_type IS NULL OR r.only_type = c.account_type)""",
]
_ARN = "'arn:aws:iam::' || account_id || ':role/' || expected_name"
_TAGS = "CASE WHEN purpose = 'S3Access' THEN '' ELSE 'Application=' || app_name || ';Environment=' || env_name || ';Purpose=' || purpose END"
ORACLES["q1_requirements"] = f"""{with_tables(*REQUIRED)}
SELECT context_id, 'IamRole' AS resource_type, purpose, expected_name, {_ARN} AS expected_arn, rules, {_TAGS} AS tags FROM needed"""

ROLES = """roles AS (SELECT account_id AS role_account, expected_name AS role_name, max(CASE WHEN app_name = 'AppOne' THEN 1 ELSE 0 END) AS trusted,
    max(CASE WHEN region <> 'us-west-1' THEN 1 ELSE 0 END) AS has_policy
  FROM needed WHERE version <> 'vP' AND expected_name IS NOT NULL AND NOT (region = 'us-west-2' AND purpose = 'S3Access')
    AND NOT (region = 'us-east-1' AND account_id = '100000000000' AND purpose = 'EcsTask')
  GROUP BY 1, 2)"""
CHECKED = """checked AS (SELECT n.*, role_name IS NOT NULL AS present,
    CASE WHEN expected_name IS NULL THEN 'Error validating resource: Unknown environment: ' || env_name
      WHEN role_name IS NULL THEN 'IAM role ''' || expected_name || ''' does not exist'
      ELSE concat_ws(',', CASE WHEN purpose <> 'S3Access' AND trusted = 0 THEN 'Role cannot assume ECS tasks' END,
                          CASE WHEN purpose = 'EcsExecution' AND has_policy = 0 THEN 'Role missing ECS execution policy' END) END AS errors,
    CASE WHEN role_name IS NOT NULL AND purpose <> 'EcsExecution' THEN 'S3 access validation not fully implemented' ELSE '' END AS warnings
  FROM needed n LEFT JOIN roles ON role_account = account_id AND role_name = expected_name)"""
CHECK = with_tables(*REQUIRED, ROLES, CHECKED)
ORACLES["q2_role_checks"] = f"""{CHECK}
SELECT context_id, purpose, expected_name, present AS exists, expected_name IS NOT NULL AS follows_name, present AND errors = '' AS has_permissions,
  errors, warnings, present AND errors = '' AS is_valid FROM checked"""
ORACLES["q3_summary"] = f"""{CHECK}
SELECT env_name, account_id, count(*) AS total, count(*) FILTER (WHERE present AND errors = '') AS valid,
  count(*) FILTER (WHERE NOT (present AND errors = '')) AS invalid, count(*) FILTER (WHERE NOT present) AS missing,
  count(*) FILTER (WHERE expected_name IS NULL) AS bad_names, bool_and(present AND errors = '') AS all_valid
FROM checked GROUP BY env_name, account_id"""
ORACLES["q3_levels"] = f"""{CHECK}
SELECT env_name, account_id, CASE grouping(env_name, account_id) WHEN 0 THEN 'env_name,account_id' WHEN 2 THEN 'account_id' ELSE '' END AS level,
  count(*) AS total, count(*) FILTER (WHERE present AND errors = '') AS valid,
  count(*) FILTER (WHERE NOT (present AND errors = '')) AS invalid, count(*) FILTER (WHERE NOT present) AS missing,
  count(*) FILTER (WHERE expected_name IS NULL) AS bad_names, bool_and(present AND errors = '') AS all_valid
FROM checked GROUP BY GROUPING SETS ((env_name, account_id), (account_id), ())"""
_MESSAGES = """messages AS (
  SELECT env_name, account_id, context_id, purpose, 'error' AS severity, unnest(string_split(errors, ',')) AS text FROM checked WHERE errors <> ''
  UNION ALL SELECT env_name, account_id, context_id, purpose, 'warning', warnings FROM checked WHERE warnings <> '')"""
ORACLES["q3_messages"] = f"""{CHECK}, {_MESSAGES}
SELECT env_name, account_id, severity, 'IamRole:' || purpose || ': ' || text AS message, count(*) AS n FROM messages GROUP BY 1, 2, 3, 4"""
ORACLES["q4_all_valid"] = f"{CHECK} SELECT coalesce(bool_and(present AND errors = ''), TRUE) AS all_valid FROM checked"
ORACLES["q4_errors"] = f"""{CHECK}, {_MESSAGES} SELECT context_id, purpose, text AS error FROM messages WHERE severity = 'error'"""
ORACLES["q5_requirement_report"] = f"""{with_tables(*REQUIRED)},
lines AS (SELECT 'IamRole' AS resource_type, expected_name, {_ARN} AS expected_arn, rules, {_TAGS} AS tags, count(*) AS n_contexts
  FROM needed GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY resource_type) AS section_lines, CAST(sum(n_contexts) OVER (PARTITION BY resource_type) AS BIGINT) AS section_total FROM lines"""
ORACLES["q6_last_results"] = f"""{with_tables("layers")}
SELECT scope, 'IamRole:' || key AS resource, arg_max(value > 20, priority) AS is_valid, max(priority) AS sequence FROM layers GROUP BY 1, 2"""
ORACLES["q7_tag_violations"] = f"""{with_tables("tag_rows")}
SELECT resource_id, 'Environment' AS tag, 'Development' AS expected, environment AS actual, CASE WHEN environment IS NULL THEN 'missing' ELSE 'wrong' END AS problem
FROM tag_rows WHERE environment IS DISTINCT FROM 'Development'
UNION ALL SELECT resource_id, 'Application', 'BUILDING', application, 'wrong' FROM tag_rows WHERE scope = 'secret' AND application <> 'BUILDING'
UNION ALL SELECT resource_id, 'ManagedBy', 'CDK', NULL, 'missing' FROM tag_rows WHERE scope = 'role'"""
ORACLES["q8_endpoints"] = f"""{with_tables("endpoints", "services")}
SELECT service, service_name, count(pos) AS n_endpoints, coalesce(arg_min(state, pos), 'none') AS status
FROM services LEFT JOIN endpoints USING (service) GROUP BY service, service_name"""
ORACLES["q9_existence"] = f"""{with_tables("tag_rows", "order_keys")}
SELECT t.resource_id, count(o.resource_id) > 0 AS present, CASE WHEN count(o.resource_id) > 0 THEN coalesce(max(kms_key_id), 'default') END AS kms_key_id
FROM tag_rows t LEFT JOIN order_keys o ON o.resource_id = t.resource_id GROUP BY t.resource_id"""
ORACLES["q10_drift"] = f"""{with_tables("expected_state", "actual_state")}, signed AS (
  SELECT id, status, tier, CAST(price AS VARCHAR) AS price, 1 AS s FROM expected_state UNION ALL SELECT id, status, tier, CAST(price AS VARCHAR), -1 FROM actual_state),
rest AS (SELECT id, status, tier, price, sum(s) AS d FROM signed GROUP BY ALL HAVING sum(s) <> 0),
k AS (SELECT id, CAST(sum(greatest(d, 0)) AS BIGINT) AS e, CAST(sum(greatest(-d, 0)) AS BIGINT) AS a,
  max(status) FILTER (d > 0) AS es, max(status) FILTER (d < 0) AS ast, max(tier) FILTER (d > 0) AS et, max(tier) FILTER (d < 0) AS att,
  max(price) FILTER (d > 0) AS ep, max(price) FILTER (d < 0) AS ap FROM rest GROUP BY id)
SELECT id, 'removed' AS change, NULL AS field, NULL AS old_value, NULL AS new_value FROM (SELECT id, unnest(range(e)) FROM k WHERE a = 0)
UNION ALL SELECT id, 'added', NULL, NULL, NULL FROM (SELECT id, unnest(range(a)) FROM k WHERE e = 0)
UNION ALL SELECT id, 'changed', 'status', es, ast FROM k WHERE e = 1 AND a = 1 AND es IS DISTINCT FROM ast
UNION ALL SELECT id, 'changed', 'tier', et, att FROM k WHERE e = 1 AND a = 1 AND et IS DISTINCT FROM att
UNION ALL SELECT id, 'changed', 'price', ep, ap FROM k WHERE e = 1 AND a = 1 AND ep IS DISTINCT FROM ap
UNION ALL SELECT id, 'ambiguous', NULL, CAST(e AS VARCHAR), CAST(a AS VARCHAR) FROM k WHERE e > 0 AND a > 0 AND e + a > 2"""
ORACLES["q10_range_drift"] = ORACLES["q10_drift"]
_ENV = "'$.environments.' || CASE o_orderkey % 5 WHEN 0 THEN 'development' WHEN 1 THEN 'integration' WHEN 2 THEN 'staging' WHEN 3 THEN 'production' ELSE 'sandbox' END"
ORACLES["q10_document_drift"] = f"""WITH o AS (SELECT *, {_ENV} AS env, o_orderkey % 50 = 49 AS gone FROM orders),
wanted AS (
  SELECT o_orderkey, gone, env || '.accountid' AS path, '10000000000' || o_custkey % 4 AS old, CASE WHEN o_orderkey % 9 <> 4 THEN '10000000000' || o_custkey % 4 END AS new FROM o WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, gone, env || '.accounttype', t, t FROM (SELECT *, CASE WHEN o_custkey % 3 = 1 THEN 'Production' ELSE 'bogus' END AS t FROM o WHERE o_custkey % 3 <> 0)
  UNION ALL SELECT o_orderkey, gone, env || '.region', r, CASE WHEN o_orderkey % 10 = 1 THEN 'us-west-1' ELSE r END FROM (SELECT *, CASE WHEN o_orderkey % 11 = 3 THEN 'eu-west-1' ELSE 'us-west-2' END AS r FROM o WHERE o_orderkey % 4 <> 0)
  UNION ALL SELECT o_orderkey, gone, env || '.tags.owner', o_orderpriority, o_orderpriority FROM o
  UNION ALL SELECT o_orderkey, gone, env || '.tags.region', 'r', 'r' FROM o UNION ALL SELECT o_orderkey, gone, env || '.tags.tags', 't', 't' FROM o
  UNION ALL SELECT o_orderkey, gone, env || '.tags.extra[0]', NULL, '1.5' FROM o WHERE o_orderkey % 15 = 2 AND NOT gone
  UNION ALL SELECT o_orderkey, gone, env || '.tags.extra[1].a\\.b', NULL, 'null' FROM o WHERE o_orderkey % 15 = 2 AND NOT gone)
SELECT o_orderkey AS registry_id, path, CASE WHEN gone OR new IS NULL THEN 'removed' WHEN old IS NULL THEN 'added' ELSE 'changed' END AS change,
  CASE WHEN NOT gone AND new IS NOT NULL THEN old END AS old_value, CASE WHEN NOT gone AND old IS NOT NULL THEN new END AS new_value
FROM wanted WHERE gone OR old IS DISTINCT FROM new"""
ORACLES["q11_rule_differences"] = f"""{with_tables("expected_state", "actual_state")},
gone AS (SELECT status, tier FROM expected_state EXCEPT ALL SELECT status, tier FROM actual_state),
extra AS (SELECT status, tier FROM actual_state EXCEPT ALL SELECT status, tier FROM expected_state)
SELECT status, tier, 'missing' AS side, count(*) AS n FROM gone GROUP BY 1, 2
UNION ALL SELECT status, tier, 'unexpected', count(*) FROM extra GROUP BY 1, 2"""

# --- topology ----------------------------------------------------------------------------

ORACLES["t1_unresolved_imports"] = f"""{with_tables("imports", "exports")}
SELECT * FROM imports i WHERE NOT EXISTS (SELECT 1 FROM exports e WHERE published AND e.name = i.name AND e.account_no = i.account_no AND e.region = i.region)"""
ORACLES["t1_expected_imports"] = f"""{with_tables("contexts", values("im", "stack, suffix", NEVER_EXPORTED))}
SELECT DISTINCT env_name, app_name, stack, env_name || '-' || suffix AS import_name FROM contexts, im"""
ORACLES["t2_duplicate_exports"] = f"""{with_tables("exports")}
SELECT account_no, region, name, count(*) AS n FROM exports WHERE published GROUP BY 1, 2, 3 HAVING count(*) > 1"""
ORACLES["t3_deploy_levels"] = f"""WITH RECURSIVE stack_deps AS ({TABLES['stack_deps']}), nodes AS ({TABLES['stack_nodes']}),
deps AS (SELECT DISTINCT node, depends_on FROM stack_deps WHERE depends_on IN (SELECT node FROM nodes)),
circle AS (SELECT unnest([3, 7])::BIGINT AS node UNION SELECT d.node FROM circle JOIN deps d ON d.depends_on = circle.node),
round AS (SELECT 3::BIGINT AS node UNION SELECT d.depends_on FROM round JOIN deps d ON d.node = round.node),
walk AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT node FROM deps)
  UNION SELECT d.node, w.level + 1 FROM walk w JOIN deps d ON d.depends_on = w.node WHERE d.node NOT IN (SELECT node FROM circle)),
deepest AS (SELECT node, max(level) AS level FROM walk GROUP BY node),
highest AS (SELECT d.node, max(n.declared_order) AS highest FROM deps d JOIN nodes n ON n.node = d.depends_on GROUP BY d.node)
SELECT n.node, CAST(level AS INTEGER) AS level, CAST(n.declared_order AS INTEGER) AS declared_order, r.node IS NOT NULL AS in_cycle,
  CASE WHEN r.node IS NOT NULL THEN 3::BIGINT END AS cycle_id, level IS NULL AND r.node IS NULL AS behind_cycle,
  coalesce(n.declared_order <= highest, FALSE) AS order_violation
FROM nodes n LEFT JOIN deepest USING (node) LEFT JOIN highest USING (node) LEFT JOIN round r ON r.node = n.node AND r.node IN (FROM circle)"""
ORACLES["t4_undeclared_dependencies"] = f"""{with_tables("imports", "exports", "declared_deps")},
owners AS (SELECT account_no, region, name, min(stack_id) AS depends_on FROM exports WHERE published GROUP BY ALL)
SELECT i.stack_id, depends_on FROM imports i JOIN owners USING (account_no, region, name) WHERE i.stack_id <> depends_on
EXCEPT SELECT stack_id, depends_on FROM declared_deps WHERE declared"""
_ITEMS = values("items", "case_no, pos, item, n", [(0, 0, None, 3), (0, 1, "sub-x", 3), (0, 2, "sub-y", 3), (1, 0, None, 2), (1, 1, "sub-x", 2), (2, 0, "sub-only", 1)])
ORACLES["t5_list_imports"] = f"""WITH {_ITEMS}
SELECT s_suppkey AS export_id, CAST(n AS INTEGER) AS n_items, n = 3 AS size_ok, CAST(pos AS INTEGER) AS pos, coalesce(item, 'sub-' || s_suppkey) AS item
FROM supplier JOIN items ON s_suppkey % 3 = case_no WHERE s_suppkey % 6 <> 5
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 6 = 5"""
ORACLES["t5_list_exports"] = f"{with_tables('list_exports')} SELECT export_id, joined FROM list_exports"

# --- policy ------------------------------------------------------------------------------

_FLAT = [
    (c, no, sid, effect, a, r, na, nr, error)
    for c, no, sid, effect, actions, resources, na, nr, _, _, error in _POLICY_STATEMENTS
    for a in (actions.split(",") if actions else ["*" if na else None])
    for r in (resources.split(",") if resources else ["*" if nr else None])
]
ORACLES["p1_statements"] = f"""WITH {values("p", "case_no, statement_no, sid, effect, action, resource, not_actions, not_resources, error", _FLAT)}
SELECT o_orderkey AS policy_id, CAST(statement_no AS INTEGER) AS statement_no, sid, effect, action, resource, not_actions, not_resources, error
FROM orders JOIN p ON {_POLICY_CASE} = case_no"""
ORACLES["p2_policy_checks"] = f"""SELECT o_orderkey AS policy_id, {_POLICY_CASE} IN (1, 2) AS has_action_0, {_POLICY_CASE} IN (1, 2) AS has_action_1,
  {_POLICY_CASE} IN (1, 2) AS has_path, {_POLICY_CASE} IN (2, 6) AS has_deny FROM orders"""
ORACLES["p2_policy_checks_strict"] = f"""SELECT o_orderkey AS policy_id, {_POLICY_CASE} IN (1, 2) AS has_action_0, {_POLICY_CASE} = 1 AS has_action_1,
  {_POLICY_CASE} IN (1, 2) AS has_path, {_POLICY_CASE} IN (2, 6) AS has_deny FROM orders"""
ORACLES["p4_unsupported_conditions"] = f"""SELECT o_orderkey AS policy_id, CAST(0 AS INTEGER) AS statement_no, 'G' AS sid, 'StringNotEquals' AS op, 'k' AS key
FROM orders WHERE {_POLICY_CASE} = 6"""


def _glob_like(pattern: str) -> str:
    return pattern.replace("_", "\\_").replace("*", "%").replace("?", "_")


_ST_FLAT = [
    (p, sid, effect, _glob_like(a.lower()), _glob_like(r), c[1] if c else None, i)
    for i, (p, sid, effect, actions, resources, c) in enumerate(SAMPLE_STATEMENTS) for a in actions for r in resources
]
_ST = values("st", "principal, sid, effect, action_like, resource_like, cond_key, no", _ST_FLAT)
_CONDS = values(
    "conds", "no, cond_op, value_like",
    [(i, c[0], _glob_like(v)) for i, (_, _, _, _, _, c) in enumerate(SAMPLE_STATEMENTS) if c for v in c[2]],
)
_ASKED = "r AS (SELECT *, row_number() OVER () AS rid FROM access_requests)"
_DECIDE = """decided AS (SELECT rid, count(*) FILTER (effect = 'Deny' AND judged) AS denies, count(*) FILTER (effect = 'Deny' AND NOT judged) AS open,
  count(*) FILTER (effect = 'Allow' AND judged) AS allows, min(sid) FILTER (effect = 'Deny' AND judged) AS deny_sid,
  min(sid) FILTER (effect = 'Deny' AND NOT judged) AS open_sid, min(sid) FILTER (effect = 'Allow' AND judged) AS allow_sid FROM hits GROUP BY rid)"""
_DECISION = """CASE WHEN denies > 0 THEN 'explicit_deny' WHEN open > 0 THEN 'undetermined' WHEN allows > 0 THEN 'allow' ELSE 'implicit_deny' END AS decision,
  CASE WHEN denies > 0 THEN deny_sid WHEN open > 0 THEN open_sid ELSE allow_sid END AS matched_sid"""
_HIT = "r.principal = st.principal AND lower(r.action) LIKE action_like ESCAPE '\\' AND r.resource LIKE resource_like ESCAPE '\\'"
ORACLES["p3_evaluate"] = f"""{with_tables("access_requests", _ST, _ASKED)}, hits AS (SELECT rid, effect, sid, TRUE AS judged FROM r JOIN st ON {_HIT}), {_DECIDE}
SELECT r.request_id, principal, action, resource, {_DECISION} FROM r LEFT JOIN decided USING (rid)"""
ORACLES["p4_conditions"] = f"""{with_tables("access_requests", _ST, _CONDS, _ASKED)}, hits AS (
  SELECT rid, effect, sid, st.no NOT IN (SELECT no FROM conds WHERE cond_op = 'StringNotEquals') AS judged FROM r JOIN st ON {_HIT}
  WHERE cond_key IS NULL OR EXISTS (SELECT 1 FROM conds WHERE conds.no = st.no
    AND (cond_op = 'StringNotEquals' OR CASE cond_key WHEN 'kms:ViaService' THEN via_service ELSE resource END LIKE value_like ESCAPE '\\'))), {_DECIDE}
SELECT r.request_id, {_DECISION} FROM r LEFT JOIN decided USING (rid)"""

_READ = "secretsmanager:GetSecretValue,secretsmanager:DescribeSecret"
_OTHERS = "concat_ws(';', " + ", ".join(f"CASE WHEN lower(env_name) <> '{e[0].lower()}' THEN '/{e[0].lower()}/*' END" for e in ENVIRONMENTS) + ")"
ORACLES["p5_isolation_rules"] = f"""{with_tables("contexts")}, b AS (SELECT *, 'arn:aws:secretsmanager:' || region || ':' || account_id || ':secret:/' || lower(env_name) AS base FROM contexts)
SELECT context_id, 'AllowSecretsManagerAccess' AS sid, 'Allow' AS effect, '{_READ}' AS actions, base || '/' || lower(app_name) || '/*,' || base || '/shared/*' AS resources, '' AS conditions FROM b
UNION ALL SELECT context_id, 'AllowKMSDecrypt', 'Allow', 'kms:Decrypt,kms:DescribeKey,kms:GenerateDataKey', '*', 'StringEquals|kms:ViaService|secretsmanager.' || region || '.amazonaws.com' FROM b
UNION ALL SELECT context_id, 'DenyCrossEnvironmentSecrets', 'Deny', '{_READ}', '*', 'ForAnyValue:StringLike|secretsmanager:SecretId|' || {_OTHERS} FROM b"""

ORACLES["p6_trust_subjects"] = f"""{with_tables("ci_subjects", values("trust", "role, aud, pattern, subject_like", [(r, a, p, _glob_like(p)) for r, a, p in SAMPLE_TRUST]))}
SELECT event_id, audience, subject, role, pattern FROM ci_subjects JOIN trust ON audience = aud AND subject LIKE subject_like ESCAPE '\\'"""

# kind of document, audience and subject it is about, decision, patterns; the first row that fits a kind and subject counts
_TRUST_CASES = values(
    "cases", "no, kind, aud_like, sub_like, decision, patterns",
    [
        (1, 0, "sts.amazonaws.com", "repo:org/app:ref:refs/heads/feature/%", "allow", "repo:org/app:ref:refs/heads/feature/*"),
        (2, 0, "sts.amazonaws.com", "repo:org/app:pull\\_request", "allow", "repo:org/app:pull_request"),
        (3, 1, "sts.amazonaws.com", "%", "undetermined", ""),
        (4, 2, "sts.amazonaws.com", "%", "undetermined", ""),
        (5, 3, "%", "%", "undetermined", ""),
        (6, 4, "sts.amazonaws.com", "%", "undetermined", ""),
        (7, 5, "%", "repo:org/app:pull\\_request", "explicit_deny", "repo:org/app:pull_request"),
        (8, 5, "%", "repo:org/%", "allow", "repo:org/*"),
        (9, 7, "other.audience", "%", "allow", ""),
        (10, 8, "sts.amazonaws.com", "repo:org/app:ref:refs/%", "undetermined", ""),
        (11, 8, "%", "repo:org/app:ref:refs/%", "allow", "repo:org/app:ref:refs/*"),
        (12, 11, "%", "repo:org/app:ref:refs/tags/v_", "allow", "repo:org/app:ref:refs/tags/v?"),
        (13, 11, "%", "%:pull\\_request", "allow", "*:pull_request"),
        (14, 11, "sts.%", "%", "allow", ""),
    ],
)
ORACLES["p6_trust_documents"] = f"""{with_tables("ci_subjects", _TRUST_CASES)}, asked AS (SELECT DISTINCT audience, subject FROM ci_subjects)
SELECT audience, subject, o_orderkey AS role, arg_min(decision, no) AS decision, arg_min(patterns, no) AS patterns
FROM asked JOIN cases ON audience LIKE aud_like AND subject LIKE sub_like ESCAPE '\\'
  JOIN orders ON o_orderkey % 1000 = kind GROUP BY ALL"""

# --- traffic -----------------------------------------------------------------------------

def _routes(table: str) -> str:
    return f"""asked AS (SELECT *, row_number() OVER () AS rid FROM http_requests),
hits AS (SELECT rid, target, row_number() OVER (PARTITION BY rid ORDER BY priority NULLS LAST, target) AS place
  FROM asked JOIN {table} ON asked.port = rule_port AND path LIKE path_like ESCAPE '\\')
SELECT page_id, path, CAST(asked.port AS INTEGER) AS port, coalesce(target, 'app') AS target FROM asked LEFT JOIN (FROM hits WHERE place = 1) USING (rid)"""


_SAMPLE_ROUTES = values("rt", "rule_port, priority, path_like, target", [(p, n, _glob_like(g), t) for p, n, g, t in SAMPLE_ROUTES])
_MANY = "rt AS (SELECT port AS rule_port, priority, replace(replace(pattern, '*', '%'), '?', '_') AS path_like, target FROM many_routes)"
ORACLES["r1_routes"] = with_tables("http_requests", _SAMPLE_ROUTES).rstrip() + ",\n" + _routes("rt")
ORACLES["r1_many_routes"] = with_tables("http_requests", "many_routes", _MANY).rstrip() + ",\n" + _routes("rt")
ORACLES["r2_health_states"] = f"""{with_tables("probes")},
placed AS (SELECT * FROM probes WHERE target IS NOT NULL AND ts IS NOT NULL),
flips AS (SELECT *, CASE WHEN min(CAST(ok AS INTEGER)) OVER two = 1 AND count(*) OVER two = 2 THEN 'healthy'
    WHEN max(CAST(ok AS INTEGER)) OVER three = 0 AND count(*) OVER three = 3 THEN 'unhealthy' END AS flip
  FROM placed WINDOW two AS (PARTITION BY target ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
    three AS (PARTITION BY target ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT target, event_id, ok, coalesce(last_value(flip IGNORE NULLS) OVER (PARTITION BY target ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS state
FROM flips
UNION ALL SELECT target, event_id, ok, NULL FROM probes WHERE target IS NULL OR ts IS NULL"""
ORACLES["r3_lifecycle"] = f"""{with_tables("objects")}
SELECT {RES}, created, class, CASE WHEN created > DATE '{AS_OF}' THEN 'not_yet' WHEN created IS NULL THEN NULL
  WHEN class = 'logs' AND DATE '{AS_OF}' - created >= 30 THEN 'expired'
  WHEN class = 'documents' AND DATE '{AS_OF}' - created >= 90 THEN 'archive' WHEN class = 'documents' AND DATE '{AS_OF}' - created >= 30 THEN 'infrequent_access'
  ELSE 'standard' END AS stage FROM objects"""
ORACLES["r4_dead_letters"] = f"""{with_tables("messages", values("limits", "queue, most", [("view", 1), ("click", 2), ("error", 1)]))}
SELECT queue, message_id, count(*) AS receives, CASE WHEN most IS NOT NULL THEN CAST(max(ts) AS DATE) + 14 END AS expires_on,
  CASE WHEN most IS NOT NULL THEN CAST(max(ts) AS DATE) + 14 <= DATE '2024-02-01' END AS expired, CASE WHEN most IS NULL THEN 'queue without a limit: ' || queue END AS error
FROM messages LEFT JOIN limits USING (queue) GROUP BY queue, message_id, most HAVING most IS NULL OR count(*) > most"""
ORACLES["r5_rotation_due"] = f"""{with_tables("objects")}, ages AS (
  SELECT l_orderkey, CAST(DATE '{AS_OF}' - max(created) FILTER (created <= DATE '{AS_OF}') AS INTEGER) AS age_days, count(created) AS dated FROM objects GROUP BY l_orderkey)
SELECT l_orderkey, age_days, CASE WHEN age_days > 30 THEN 'due' WHEN age_days IS NOT NULL THEN 'current' WHEN dated > 0 THEN 'not_yet' ELSE 'unknown' END AS state FROM ages"""
ORACLES["st1_drift_windows"] = f"""{with_tables("drift_events")}, w AS (SELECT env_id, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS s FROM drift_events WHERE is_drift)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 4 HOURS, '%Y-%m-%d %H:%M:%S') AS window_end, env_id, count(*) AS n FROM w GROUP BY s, env_id"""
ORACLES["st1_drift_stream"] = ORACLES["st1_drift_windows"]
