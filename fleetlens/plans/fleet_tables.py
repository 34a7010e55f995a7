"""The driver's tables read as a fleet.

Each block is one SELECT that Spark and the checking database run unchanged. What needs
nested columns is added with DataFrame functions below.
"""

from __future__ import annotations

import os
import re
import uuid
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.operators import names
from fleetlens.settings import Settings

SETTINGS = Settings()


def _env(key: str) -> str:
    return (
        f"CASE CAST({key} % 5 AS INT) WHEN 0 THEN 'Development' WHEN 1 THEN 'Integration' "
        "WHEN 2 THEN 'Staging' WHEN 3 THEN 'Production' ELSE 'Sandbox' END"
    )


def _region(key: str) -> str:
    return (
        f"CASE CAST({key} % 4 AS INT) WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-east-2' "
        "WHEN 2 THEN 'us-west-1' ELSE 'us-west-2' END"
    )


def _app(key: str) -> str:
    return f"CASE CAST({key} % 2 AS INT) WHEN 0 THEN 'AppOne' ELSE 'Cdk' END"


_NAME = (
    "CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'web' WHEN 1 THEN 'api' WHEN 2 THEN 'Cron-Report' "
    "WHEN 3 THEN 'loader' WHEN 4 THEN 'sync-worker' ELSE '' END"
)
_IMAGE = (
    "CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'placeholder' WHEN 1 THEN 'repo/app:1' "
    "WHEN 2 THEN '' ELSE CAST(NULL AS VARCHAR(20)) END"
)
_PROTOCOL = "CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'Tcp' ELSE CAST(NULL AS VARCHAR(20)) END"
_ESSENTIAL = "CASE WHEN l_linenumber = 7 THEN CAST(NULL AS BOOLEAN) ELSE l_linestatus = 'O' END"
_SECRET = (
    "CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN 'OpenAiOptions__ApiKey' "
    "WHEN 1 THEN 'OPENAIOPTIONS-APIKEY' ELSE 'Cognito__Domain' END"
)
_PORTS = "CAST(CAST(l_quantity AS BIGINT) % 5 AS INT)"
_DOC_CASE = "CAST((l_partkey + l_linenumber) % 10 AS INT)"
_DOC_ID = "concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)))"

_quoted = lambda e: f"coalesce(concat('\"', {e}, '\"'), 'null')"
_port_json = lambda n: f"'{{\"containerPort\":{n},\"protocol\":', {_quoted(_PROTOCOL)}, '}}'"

_CONTAINER_JSON = f"""concat(CASE WHEN l_linenumber = 3 THEN '{{"Name":' ELSE '{{"name":' END, {_quoted(_NAME)}, ',"image":', {_quoted(_IMAGE)},
  ',"portMappings":', CASE {_PORTS} WHEN 0 THEN 'null' WHEN 1 THEN '[]'
     WHEN 2 THEN concat('[', {_port_json(8080)}, ']')
     WHEN 3 THEN concat('[', {_port_json(80)}, ',', {_port_json(8080)}, ']')
     ELSE concat('[', {_port_json(70000)}, ',]') END,
  ',"essential":', CASE WHEN l_linenumber = 7 THEN 'null' WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END,
  ',"secrets":["', {_SECRET}, '"], "mountPoints":[]}}')"""

TABLES = {
    "fleet_resources": f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_env('l_orderkey')} AS env_name,
  {_region('l_suppkey')} AS region, {_app('l_partkey')} AS app_name,
  CAST((l_partkey + l_linenumber) % 8 AS INT) AS kind_id,
  CAST(CAST(l_quantity AS BIGINT) % 10 AS INT) AS noise, l_shipdate AS seen_at
FROM lineitem""",
    "container_rows": f"""
SELECT l_orderkey AS doc_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_shipdate, {_NAME} AS name, {_IMAGE} AS image, {_PORTS} AS ports_case,
  {_PROTOCOL} AS protocol, {_ESSENTIAL} AS essential, {_SECRET} AS secret_var,
  CAST(l_linenumber % 4 AS INT) AS env_case, CAST(l_partkey % 5 AS INT) AS health_case,
  l_suppkey % 5 = 0 AS health_off, {_env('l_orderkey')} AS env_name, {_app('l_partkey')} AS app_name
FROM lineitem""",
    "service_texts": f"""
SELECT {_DOC_ID} AS doc_id, l_orderkey AS context_id, {_env('l_orderkey')} AS env_name,
  CASE {_DOC_CASE} WHEN 0 THEN '{{"vpcNamePattern":"dev"}}'
    WHEN 1 THEN '{{"ecsConfiguration":{{"taskDefinition":[]}}}}'
    WHEN 2 THEN '{{"ecsConfiguration":{{"taskDefinition":[{{"taskDefinitionName":" ","containerDefinitions":[]}}]}}}}'
    ELSE concat(CASE WHEN l_linenumber = 3 THEN '{{"EcsConfiguration":{{ /* one, "task", ] */ "serviceName":"a,]","taskDefinition":[{{"TASKDEFINITIONNAME":"main","containerDefinitions":['
      ELSE '{{"ecsConfiguration":{{"serviceName":"a,]","taskDefinition":[{{"taskDefinitionName":"main","containerDefinitions":[' END,
      {_CONTAINER_JSON}, ',{{"name":"web","image":"repo/side:1","portMappings":[{{"containerPort":8443,"protocol":"tcp"}}],}},]}}]}}}}') END AS text
FROM lineitem""",
    "access_requests": """
SELECT event_id AS request_id, concat('role-', CAST(user_id % 4 AS VARCHAR(4))) AS principal,
  CASE event_type WHEN 'error' THEN 'secretsmanager:DescribeSecret' WHEN 'view' THEN 'SecretsManager:GetSecretValue'
       WHEN 'click' THEN 'kms:Decrypt' WHEN 'signup' THEN 'ecs:ListTasks' ELSE 's3:GetObject' END AS action,
  concat('/', CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'development' WHEN 1 THEN 'integration'
       WHEN 2 THEN 'staging' ELSE 'production' END,
       CASE WHEN event_id % 3 = 0 THEN '/shared/key' ELSE '/app.one/key' END) AS resource,
  CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS VARCHAR(40)) ELSE 'secretsmanager.us-east-2.amazonaws.com' END AS via_service
FROM events
UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN event_id END, concat('role-', CAST(user_id % 4 AS VARCHAR(4))),
  CASE WHEN event_id % 5 <> 0 THEN 'kms:Decrypt' END, '/development/app.one/key', 'secretsmanager.us-east-2.amazonaws.com'
FROM events""",
    "exports": """
SELECT concat('Development-sg-', CAST(s_suppkey % 40 AS VARCHAR(8)), '-id') AS name,
  CAST(s_nationkey % 3 AS INT) AS account_no, CASE WHEN s_suppkey % 2 = 0 THEN 'us-east-1' ELSE 'us-west-2' END AS region,
  s_suppkey AS stack_id, s_suppkey % 3 <> 0 AS published
FROM supplier""",
    "imports": """
SELECT DISTINCT concat('Development-sg-', CAST(l_suppkey % 50 AS VARCHAR(8)), '-id') AS name,
  CAST(l_orderkey % 3 AS INT) AS account_no, CASE WHEN l_suppkey % 2 = 0 THEN 'us-east-1' ELSE 'us-west-2' END AS region,
  CAST(l_partkey % 10 AS BIGINT) AS stack_id
FROM lineitem""",
    "declared_deps": """
SELECT CAST(s_suppkey % 10 AS BIGINT) AS stack_id, s_suppkey AS depends_on, s_nationkey < 12 AS declared FROM supplier""",
    "stack_nodes": "SELECT p_partkey AS node, p_size AS declared_order FROM part",
    "stack_deps": """
SELECT p_partkey AS node, CASE WHEN p_partkey = 3 THEN CAST(7 AS BIGINT) WHEN p_partkey % 4 = 0 AND p_partkey > 4 THEN p_partkey - 4
    WHEN p_partkey > 1 THEN CAST(floor(p_partkey / 2.0) AS BIGINT) END AS depends_on, p_size AS declared_order
FROM part
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 AND p_partkey > 9 THEN p_partkey - 9 END, p_size FROM part""",
    "manifest_texts": """
SELECT p_partkey AS manifest_id, concat('{"stackConfiguration":{"applicationName":"AppOne","stacks":[{"name":"S',
  CAST(p_partkey AS VARCHAR(20)), '","id":"alb","dependsOn":', CASE WHEN p_partkey % 3 = 0 THEN '[]' ELSE concat('["S',
  CAST(floor(p_partkey / 2.0) AS BIGINT), '"]') END, ',"deploymentOrder":', CAST(p_size AS VARCHAR(20)),
  ',"exports":["', p_brand, '","alb-arn"]}, /* second */ {"name":"T","id":"ecs","imports":["alb-arn"]},]}}') AS text
FROM part""",
    "probes": """
SELECT CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 10 <> 0 THEN 0 ELSE CAST(user_id % 20 AS INT) END AS target,
  CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, event_id, event_type NOT IN ('error', 'click') AS ok FROM events""",
    "objects": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 31 <> 0 THEN CAST(l_shipdate AS DATE) END AS created,
  CASE WHEN l_returnflag = 'R' THEN 'logs' ELSE 'documents' END AS class
FROM lineitem""",
    "http_requests": """
SELECT CASE WHEN page_id % 5 <> 0 THEN page_id % 100 END AS page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
  CASE WHEN page_id % 41 = 0 THEN NULL WHEN substr(url, 1, 5) = 'https' THEN 443 ELSE 80 END AS port
FROM pages""",
    "many_routes": """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 443 ELSE 80 END AS port, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size % 7 AS INT) END AS priority,
  concat('/', language, CASE WHEN p_partkey % 3 = 0 THEN '/*' ELSE '/' END, CAST(p_partkey AS VARCHAR(20)),
    CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN '.h*l' WHEN 3 THEN '/*' ELSE '?html' END) AS pattern,
  concat('service-', CAST(p_partkey AS VARCHAR(20))) AS target
FROM part CROSS JOIN (SELECT 'en' AS language UNION ALL SELECT 'de' UNION ALL SELECT 'fr' UNION ALL SELECT 'es'
  UNION ALL SELECT 'it' UNION ALL SELECT 'nl') languages""",
    "messages": """
SELECT event_type AS queue, concat(CAST(user_id AS VARCHAR(20)), ':', props) AS message_id, event_id, ts FROM events""",
    "expected_state": """
SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS tier, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders
UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END, 'again', o_orderpriority, CAST(1 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 97 < 2
UNION ALL SELECT o_orderkey, 'first', o_orderpriority, CAST(2 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 51 < 2""",
    "actual_state": """
SELECT o_orderkey AS id, o_orderstatus AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN 'manual' ELSE o_orderpriority END AS tier, CAST(o_totalprice AS DECIMAL(18,2)) AS price
FROM orders WHERE o_orderkey % 17 <> 0
UNION ALL
SELECT -o_orderkey - 1, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 101 = 0
UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END, 'again', o_orderpriority, CAST(1 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 97 < 2
UNION ALL SELECT o_orderkey, 'second', o_orderpriority, CAST(2 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 51 < 2""",
    "tag_rows": """
SELECT c_custkey AS resource_id, CASE WHEN c_nationkey % 2 = 0 THEN 'secret' ELSE 'role' END AS scope,
  CASE WHEN c_custkey % 9 = 0 THEN CAST(NULL AS VARCHAR(20)) WHEN c_custkey % 5 = 0 THEN 'development' ELSE 'Development' END AS environment,
  c_mktsegment AS application
FROM customer""",
    "layers": "SELECT user_id AS scope, event_type AS key, value, event_id AS priority FROM events",
    "endpoints": """
SELECT s_nationkey AS service, s_suppkey AS pos, CASE WHEN s_suppkey % 4 = 0 THEN 'pending' ELSE 'available' END AS state
FROM supplier""",
    "services": "SELECT n_nationkey AS service, n_name AS service_name FROM nation",
    "drift_events": "SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, CAST(user_id % 4 AS INT) AS env_id, event_type = 'error' AS is_drift FROM events",
    "contexts": f"""
SELECT o_orderkey AS context_id, {_env('o_orderkey')} AS env_name, {_app('o_orderkey')} AS app_name,
  {_region('o_custkey')} AS region, concat('10000000000', CAST(o_custkey % 4 AS VARCHAR(4))) AS account_id,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'NonProduction' WHEN 1 THEN 'NonProduction'
       WHEN 2 THEN 'Production' WHEN 3 THEN 'Production' ELSE 'Sandbox' END AS account_type,
  concat('v', o_orderstatus) AS version, o_orderdate AS deployed_at, CAST(o_orderdate AS DATE) AS deployed_on,
  o_orderpriority AS priority
FROM orders""",
    "policy_docs": """
SELECT o_orderkey AS policy_id, CASE CAST(CASE WHEN o_orderkey % 1000 = 5 THEN 8 ELSE o_orderkey % 8 END AS INT)
  WHEN 0 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Action":"s3:*","Resource":"*"}]}'
  WHEN 1 THEN '{"Statement":[{"Sid":"B","Effect":"Allow","Action":["secretsmanager:GetSecretValue","kms:Decrypt"],"Resource":["/dev/*"]}]}'
  WHEN 2 THEN '{"Statement":[{"Sid":"C","Effect":"Deny","Action":["secretsmanager:GetSecretValue"],"Resource":"*"},{"Sid":"D","Effect":"Allow","Action":"kms:Decrypt","Resource":["/dev/a","/stg/b"]}]}'
  WHEN 3 THEN '{"Statement":{"Sid":"E","Effect":"Allow","Principal":{"Service":"ecs"},"Action":"sts:AssumeRole","Resource":"*","Condition":{"StringLike":{"k":["a*","b"]}}}}'
  WHEN 4 THEN '{"Statement":[]}'
  WHEN 5 THEN '{"Statement":[{"Sid":"F","Effect":"Allow","Principal":{"Service":"ecs"},"Action":"sts:AssumeRole"}]}'
  WHEN 6 THEN '{"Statement":[{"Sid":"G","Effect":"Deny","NotAction":["s3:*"],"Resource":"*","Condition":{"StringNotEquals":{"k":"v"}}},{"Sid":"H","Effect":"Allow","Action":"s3:Get*","NotResource":["/dev/*","/stg/*"]}]}'
  WHEN 7 THEN '{broken'
  ELSE '{"Statement":[{"Sid":"T","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEquals":{"token:aud":"sts.amazonaws.com"},"StringLike":{"token:sub":["repo:org/app:ref:refs/heads/feature/*","repo:org/app:pull_request"]}}}]}' END AS text
FROM orders""",
    "list_exports": """
SELECT s_suppkey AS export_id, CASE CAST(s_suppkey % 3 AS INT)
  WHEN 0 THEN concat('sub-', CAST(s_suppkey AS VARCHAR(8)), ',sub-x,sub-y')
  WHEN 1 THEN concat('sub-', CAST(s_suppkey AS VARCHAR(8)), ',sub-x') ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'sub-only' END END AS joined
FROM supplier""",
    "ci_subjects": """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'other.audience' ELSE 'sts.amazonaws.com' END AS audience,
  concat('repo:org/app:', CASE event_type WHEN 'error' THEN 'pull_request' WHEN 'view' THEN 'ref:refs/heads/main'
         WHEN 'click' THEN 'ref:refs/heads/develop' WHEN 'signup' THEN concat('ref:refs/heads/feature/', CAST(user_id AS VARCHAR(20)))
         ELSE 'ref:refs/tags/v1' END) AS subject
FROM events""",
    "trust_docs": """
SELECT o_orderkey AS policy_id, CASE CAST(o_orderkey % 1000 AS INT)
  WHEN 0 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEquals":{"token:aud":"sts.amazonaws.com"},"StringLike":{"token:sub":["repo:org/app:ref:refs/heads/feature/*","repo:org/app:pull_request"]}}}]}'
  WHEN 1 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEquals":{"token:aud":"sts.amazonaws.com"},"StringNotLike":{"token:sub":"repo:evil/*"}}}]}'
  WHEN 2 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEquals":{"token:aud":"sts.amazonaws.com"},"ForAllValues:StringLike":{"token:sub":"repo:org/app:*"}}}]}'
  WHEN 3 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEqualsIgnoreCase":{"token:sub":"repo:org/app:pull_request"}}}]}'
  WHEN 4 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEquals":{"token:aud":"sts.amazonaws.com","token:repository_owner":"org"}}}]}'
  WHEN 5 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":["sts:AssumeRoleWithWebIdentity"],"Condition":{"StringLike":{"token:sub":"repo:org/*"}}},{"Sid":"B","Effect":"Deny","Principal":"*","Action":"sts:*","Condition":{"StringLike":{"token:sub":["repo:evil/*","repo:org/app:pull_request"]}}}]}'
  WHEN 6 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEquals":{"token:sub":"repo:org/app:ref:refs/heads/main"},"StringLike":{"token:sub":"repo:other/*"}}},{"Sid":"B","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringEquals":{"token:sub":"repo:org/app:*"}}}]}'
  WHEN 7 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"NotAction":"s3:*","Condition":{"StringEquals":{"token:aud":["other.audience","third"]}}}]}'
  WHEN 8 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringLike":{"token:sub":"repo:org/app:ref:refs/*"}}},{"Sid":"B","Effect":"Deny","Principal":"*","Action":"*","Condition":{"StringNotLike":{"token:sub":"repo:org/*"},"StringEquals":{"token:aud":"sts.amazonaws.com"}}}]}'
  WHEN 9 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Action":"sts:AssumeRoleWithWebIdentity"}]}'
  WHEN 10 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Service":"ecs"},"Action":"sts:AssumeRole"},{"Sid":"B","Effect":"Deny","Principal":"*","Action":"sts:*"}]}'
  WHEN 11 THEN '{"Statement":[{"Sid":"A","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"STS:assume*WebIdentity","Condition":{"StringLike":{"token:aud":"sts.*"}}},{"Sid":"B","Effect":"Allow","Principal":{"Federated":"oidc"},"Action":"sts:AssumeRoleWithWebIdentity","Condition":{"StringLike":{"token:sub":["repo:org/app:ref:refs/tags/v?","*:pull_request"]}}}]}' END AS text
FROM orders WHERE o_orderkey % 1000 < 12""",
    "registry_texts": """
SELECT o_orderkey AS registry_id, concat('{"Environments":{"', CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Development'
    WHEN 1 THEN 'Integration' WHEN 2 THEN 'Staging' WHEN 3 THEN 'Production' ELSE 'Sandbox' END, '":{',
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('"accountId":"10000000000', CAST(o_custkey % 4 AS VARCHAR(4)), '",') END,
  CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN '"AccountType":"Production",' ELSE '"AccountType":"bogus",' END,
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 11 = 3 THEN '"Region":"eu-west-1",' ELSE '"Region":"us-west-2",' END, '"Tags":{"Owner":"', o_orderpriority, '","region":"r","tags":"t",}}}}') AS text
FROM orders""",
    "registry_actual": """
SELECT o_orderkey AS registry_id, concat('{ "environments" : {"', CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'DEVELOPMENT'
    WHEN 1 THEN 'integration' WHEN 2 THEN 'Staging' WHEN 3 THEN 'Production' ELSE 'Sandbox' END, '":{"Tags":{"tags":"t","region":"r",',
  CASE WHEN o_orderkey % 15 = 2 THEN '"Extra":[1.50,{"a.b":null}],' ELSE '' END, '"Owner":"', o_orderpriority, '"},',
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN '"Region":"us-west-1",' WHEN o_orderkey % 11 = 3 THEN '"Region":"eu-west-1",' ELSE '"Region":"us-west-2",' END,
  CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN '"accounttype":"Production",' ELSE '"accounttype":"bogus",' END,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 9 = 4 THEN '' ELSE concat('"ACCOUNTID":"10000000000', CAST(o_custkey % 4 AS VARCHAR(4)), '",') END, '}}, /* end */ }') AS text
FROM orders WHERE o_orderkey % 50 <> 49""",
    # a document per supplier: step 1 has it before a change, step 2 after it
    "registry_files": f"""
SELECT step, s_suppkey AS doc, CASE WHEN s_suppkey % 7 = 3 THEN 'b' ELSE 'a' END AS shelf,
  CASE WHEN s_suppkey % 11 = 6 THEN concat('{{ "environments": ', CAST(step AS VARCHAR(4)))
    WHEN s_suppkey % 13 = 5 THEN ''
    ELSE concat('// registry of ', s_name, '\n{{"Environments":{{"', {_env('s_suppkey')}, '":{{"accountId":"',
      CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey * 10 + step ELSE s_nationkey END AS VARCHAR(8)), '",}}}}}}') END AS text
FROM (SELECT *, 1 AS step FROM supplier UNION ALL SELECT *, 2 FROM supplier) AS steps
WHERE (step = 1 AND s_suppkey % 4 <> 1) OR (step = 2 AND s_suppkey % 7 <> 3 AND (s_suppkey % 4 = 1 OR s_suppkey % 5 = 0))""",
    "existing_secrets": f"""
SELECT concat('/', lower({_env('s_suppkey')}), '/appone/openaioptions-apikey_', CAST(s_suppkey AS VARCHAR(20))) AS path,
  s_nationkey % 6 <> 0 AS lookup_ok
FROM supplier""",
    "secret_requests": f"""
SELECT l_orderkey, concat({_SECRET}, '_', CAST(CAST(floor(l_suppkey / 3.0) AS BIGINT) AS VARCHAR(20))) AS variable,
  {_env('l_suppkey')} AS env_name, 'AppOne' AS app_name, l_orderkey * 8 + l_linenumber AS request_no
FROM lineitem""",
    "order_keys": "SELECT o_custkey AS resource_id, CASE WHEN o_orderstatus = 'F' THEN concat('key-', o_orderpriority) END AS kms_key_id FROM orders",
    "new_codes": """
SELECT s_name AS app_name, concat('n', CAST(s_nationkey AS VARCHAR(4))) AS app_code, s_suppkey AS seq FROM supplier
UNION ALL SELECT concat(s_name, '-tie'), concat('t', CAST(s_nationkey AS VARCHAR(4))), s_nationkey FROM supplier
UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN concat(s_name, '-half') END, CASE WHEN s_suppkey % 2 = 1 THEN 'half' END, s_suppkey FROM supplier""",
}

_SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
_FROM = re.compile(r"\bFROM (" + "|".join(_SOURCES) + r")\b")


def fleet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_FROM.sub(lambda m: f"FROM parquet.`{sf_dir}/{m.group(1)}.parquet`", TABLES[name]))


# kind_id, kind, specific, service
SAMPLE_KINDS = [
    (0, "ecs_cluster", "main", None),
    (1, "ecs_service", "web", None),
    (2, "rds_instance", "primary", None),
    (3, "role", "ecs-task", None),
    (4, "shared_vpc", "main", None),
    (5, "sg_alb", "web", None),
    (6, "bucket", "docs", None),
    (7, "log_group", "api", "ecs"),
]


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved resources with kind, specific, service and the name that was observed."""
    kinds = rules.rule_table(spark, "kind_id int, kind string, specific string, service string", SAMPLE_KINDS)
    resolved = names.resolve_context(fleet_table(spark, sf_dir, "fleet_resources"), SETTINGS).join(kinds, "kind_id")
    return with_observed_name(resolved)


def with_observed_name(resolved: DataFrame) -> DataFrame:
    """Expected names with noise: upper case, a suffix, or another environment's prefix."""
    expected = names.expected_names(resolved, SETTINGS)
    wrong = F.regexp_replace("expected_name", r"(^|[-/])(dev|int|stg|prod)-", "$1dev-")
    return expected.withColumn(
        "observed_name",
        F.when(F.col("noise") == 0, F.upper("expected_name"))
        .when(F.col("noise") == 7, F.concat("expected_name", F.lit("-x")))
        .when(F.col("noise") == 3, wrong)
        .otherwise(F.col("expected_name")),
    ).drop("expected_name")


def dealt(spark: SparkSession, sf_dir: str, name: str, source: str, key: list[str]) -> DataFrame:
    """A fleet table whose source rows are dealt out first: the sample tables are one row group each, so one task."""
    view = f"dealt_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/{source}.parquet").repartition(*key).createOrReplaceTempView(view)
    rows = spark.sql(TABLES[name].replace(f"FROM {source}", f"FROM {view}"))
    spark.catalog.dropTempView(view)
    return rows


def write_documents(texts: DataFrame, folder: str, run: int) -> None:
    """(shelf, doc, text) as files: the texts of a document are the lines of one of its own for each run.

    Below ``folder`` it is shelf=<shelf>/doc=<doc>/part-<run>.txt. On a folder that is mounted tasks
    write the files themselves, as without its native library Spark's writer starts two processes
    for each file there to set its rights; elsewhere Spark writes them. Written again, a file is replaced.
    """
    spark = texts.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    # in a fixed number of parts: a file costs the same however small it is
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = texts.repartition(parts, "doc")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        placed.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("shelf", "doc").text(folder)
        return
    root, unnamed = path.toUri().getPath(), "__HIVE_DEFAULT_PARTITION__"

    def put(rows):
        for (shelf, doc), lines in groupby(rows, key=lambda row: (row["shelf"], row["doc"])):
            place = os.path.join(root, f"shelf={shelf}", f"doc={unnamed if doc is None else doc}")
            os.makedirs(place, exist_ok=True)
            unfinished = os.path.join(place, f"_{uuid.uuid4().hex}")
            with open(unfinished, "w", encoding="utf-8", newline="") as file:
                file.writelines(f"{row['text'] or ''}\n" for row in lines)
            os.replace(unfinished, os.path.join(place, f"part-{run:05d}.txt"))

    placed.sortWithinPartitions("shelf", "doc").foreachPartition(put)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet_table(spark, sf_dir, "contexts")


def resolved_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts with codes; the account type of the registry is kept."""
    base = contexts(spark, sf_dir).withColumnRenamed("account_type", "_type")
    resolved = names.resolve_context(base, SETTINGS)
    return resolved.withColumn("account_type", F.col("_type")).drop("_type")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container rows with their nested fields."""
    rows = fleet_table(spark, sf_dir, "container_rows")
    mapping = "array<struct<containerPort:int,hostPort:int,protocol:string,appProtocol:string>>"
    variable = "array<struct<name:string,value:string>>"
    health = "struct<command:array<string>,interval:int,timeout:int,retries:int,startPeriod:int,disabled:boolean>"
    return rows.withColumns(
        {
            "portMappings": F.expr(
                f"""CASE ports_case WHEN 0 THEN NULL WHEN 1 THEN cast(array() AS {mapping})
                WHEN 2 THEN array(named_struct('containerPort', 8080, 'hostPort', 8080, 'protocol', protocol, 'appProtocol', 'https'))
                WHEN 3 THEN array(named_struct('containerPort', 80, 'hostPort', cast(NULL AS int), 'protocol', protocol, 'appProtocol', 'GRPC'),
                                  named_struct('containerPort', 8080, 'hostPort', 8080, 'protocol', protocol, 'appProtocol', cast(NULL AS string)))
                ELSE array(named_struct('containerPort', 70000, 'hostPort', 0, 'protocol', protocol, 'appProtocol', '')) END"""
            ),
            "environment": F.expr(
                f"""CASE env_case WHEN 0 THEN NULL
                WHEN 1 THEN array(named_struct('name', 'NIGHTLY_CRON', 'value', '0 * * * *'))
                WHEN 2 THEN array(named_struct('name', 'health_check_path', 'value', 'status'), named_struct('name', 'PORT', 'value', '9090'))
                ELSE array(named_struct('name', 'A', 'value', ''), named_struct('name', 'ENVIRONMENT', 'value', 'Mine'),
                           named_struct('name', 'ENVIRONMENT', 'value', 'Last'), named_struct('name', cast(NULL AS string), 'value', 'x')) END"""
            ),
            "healthCheck": F.expr(
                f"""CASE health_case WHEN 0 THEN cast(NULL AS {health})
                WHEN 1 THEN named_struct('command', array('CMD-SHELL', 'curl http://localhost:8080/ready || exit 1'), 'interval', 10, 'timeout', NULL, 'retries', NULL, 'startPeriod', 5, 'disabled', NULL)
                WHEN 2 THEN named_struct('command', array('CMD', 'curl http://localhost:8080/off'), 'interval', 10, 'timeout', NULL, 'retries', NULL, 'startPeriod', NULL, 'disabled', true)
                WHEN 3 THEN named_struct('command', cast(array() AS array<string>), 'interval', 10, 'timeout', NULL, 'retries', NULL, 'startPeriod', NULL, 'disabled', false)
                ELSE named_struct('command', array('CMD', 'true'), 'interval', NULL, 'timeout', 7, 'retries', 9, 'startPeriod', NULL, 'disabled', NULL) END"""
            ),
            "disableHealthCheck": F.when(F.col("health_off"), F.lit(True)),
            "secrets": F.array("secret_var"),
        }
    )


LIST_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
