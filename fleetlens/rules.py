"""Rule tables.

All values below are fixed values of the naming convention, the sizing policy and the
stacks; results depend on them letter for letter. Every table is a local relation of rows
written out in code, so it is broadcast whatever the session's threshold; tables a caller
brings are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.settings import Settings

_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "strings": pa.list_(pa.string()),
    "map": pa.map_(pa.string(), pa.string()),
}


def rule_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """``columns`` is ``"name type, ..."``; the rows become a local relation of known size."""
    names, types = zip(*(c.split() for c in columns.split(", ")))
    arrays = [
        pa.array([row[i] for row in rows], type=_ARROW[kind]) for i, kind in enumerate(types)
    ]
    table = spark.createDataFrame(pa.table(dict(zip(names, arrays))))
    return F.broadcast(table)


# --- fixed values: naming convention -----------------------------------------------------

ENVIRONMENTS = [
    ("Development", "dev", "NonProduction"),
    ("Integration", "int", "NonProduction"),
    ("Staging", "stg", "Production"),
    ("Production", "prod", "Production"),
]

ACCOUNT_TYPES = ["NonProduction", "Production", "Sandbox", "Security", "SharedServices"]

REGIONS = [
    ("us-east-1", "ue1"),
    ("us-east-2", "ue2"),
    ("us-west-1", "uw1"),
    ("us-west-2", "uw2"),
]

DEFAULT_REGION = "us-east-1"

RESOURCE_TYPES = [
    ("EcsCluster", "ecs"),
    ("EcsTask", "task"),
    ("EcsService", "svc"),
    ("ApplicationLoadBalancer", "alb"),
    ("NetworkLoadBalancer", "nlb"),
    ("Vpc", "vpc"),
    ("SecurityGroup", "sg"),
    ("IamRole", "role"),
    ("IamUser", "user"),
    ("IamPolicy", "policy"),
    ("RdsInstance", "rds"),
    ("ElastiCache", "cache"),
    ("Lambda", "lambda"),
    ("ElasticFileSystem", "efs"),
    ("OpenSearch", "search"),
    ("BastionHost", "bastion"),
    ("S3Bucket", "bucket"),
    ("CloudWatchLogGroup", "logs"),
    ("SnsTopics", "sns"),
    ("SqsQueue", "sqs"),
    ("SecretsManager", "secret"),
    ("ParameterStore", "param"),
    ("CognitoUserPool", "cognito"),
    ("CognitoAppClient", "client"),
    ("CognitoDomain", "domain"),
]

PROTECTED_RESOURCES = [
    ("ApplicationLoadBalancer", "alb"),
    ("NetworkLoadBalancer", "nlb"),
    ("EcsService", "ecs"),
    ("RdsInstance", "rds"),
    ("ElastiCache", "cache"),
    ("Lambda", "lambda"),
    ("ElasticFileSystem", "efs"),
    ("OpenSearch", "search"),
    ("BastionHost", "bastion"),
    ("Vpc", "vpc"),
]

PURPOSES = [
    ("resource", "Main", "main"),
    ("resource", "Web", "web"),
    ("resource", "Api", "api"),
    ("resource", "Internal", "internal"),
    ("resource", "Primary", "primary"),
    ("resource", "Admin", "admin"),
    ("resource", "Auth", "auth"),
    ("storage", "App", "app"),
    ("storage", "Documents", "docs"),
    ("storage", "Uploads", "uploads"),
    ("storage", "Backups", "backups"),
    ("storage", "Cache", "cache"),
    ("storage", "Session", "session"),
    ("iam", "EcsTask", "ecs-task"),
    ("iam", "EcsExecution", "ecs-exec"),
    ("iam", "S3Access", "s3-access"),
    ("iam", "Service", "service"),
    ("queue", "Processing", "processing"),
    ("queue", "DeadLetter", "dlq"),
    ("queue", "Urgent", "urgent"),
    ("notification", "General", "notifications"),
    ("notification", "TrialUpdates", "trial-updates"),
    ("notification", "SystemAlerts", "alerts"),
    ("notification", "UserNotifications", "user-notify"),
]

# kind, template, type code, purpose family (null: free text), default purpose
NAME_KINDS = [
    ("ecs_cluster", "app", "ecs", "resource", "main"),
    ("ecs_task", "app", "task", "resource", None),
    ("ecs_task_named", "app", "task", None, None),
    ("ecs_service", "app", "svc", "resource", None),
    ("ecs_service_named", "app", "svc", None, None),
    ("application_load_balancer", "app", "alb", "resource", None),
    ("network_load_balancer", "app", "nlb", "resource", None),
    ("vpc", "app", "vpc", "resource", "main"),
    ("rds_instance", "app", "rds", "resource", None),
    ("cache", "app", "cache", "storage", None),
    ("lambda", "app", "lambda", "resource", None),
    ("search", "app", "search", "resource", None),
    ("file_system", "app", "efs", "storage", None),
    ("role", "app", "role", "iam", None),
    ("user", "app", "user", "iam", None),
    ("policy", "app", "policy", "iam", None),
    ("sg_alb", "security_group", "alb", "resource", None),
    ("sg_ecs", "security_group", "ecs", "resource", None),
    ("sg_rds", "security_group", "rds", "resource", None),
    ("sg_cache", "security_group", "cache", "storage", None),
    ("sg_lambda", "security_group", "lambda", "resource", None),
    ("sg_search", "security_group", "search", "resource", None),
    ("sg_bastion", "security_group", "bastion", "resource", "admin"),
    ("bucket", "bucket", "bucket", "storage", None),
    ("log_group", "app_log", "logs", "resource", None),
    ("topic", "app", "sns", "notification", None),
    ("queue", "app", "sqs", "queue", None),
    ("secret", "app", "secret", "resource", None),
    ("parameter", "app", "param", "resource", None),
    ("user_pool", "app", "cognito", "resource", None),
    ("app_client", "app", "client", "resource", None),
    ("auth_domain", "app", "domain", "resource", None),
    ("image_repository", "image", "image", None, None),
    ("custom", "app", None, "resource", None),
    ("role_arn", "app", "role", "iam", None),
    ("policy_arn", "app", "policy", "iam", None),
    ("user_arn", "app", "user", "iam", None),
    ("bucket_arn", "bucket", "bucket", "storage", None),
    ("queue_arn", "app", "sqs", "queue", None),
    ("topic_arn", "app", "sns", "notification", None),
    ("shared_vpc", "shared", "vpc", None, "main"),
    ("shared_sg", "shared", "sg", None, None),
    ("shared_log_group", "shared_log", "logs", None, "main"),
]

# kind, longest name, character pattern
NAME_LIMITS = [
    ("bucket", 63, r"^[a-z0-9\-\.]+$"),
    ("rds_instance", 63, None),
    ("ecs_cluster", 255, None),
    ("user_pool", 128, None),
    ("app_client", 128, None),
    ("auth_domain", 63, None),
]

# --- fixed values: sizing, settings, retention -------------------------------------------

SIZING_COLUMNS = [
    ("instance_type", "string"),
    ("min_capacity", "int"),
    ("max_capacity", "int"),
    ("desired_capacity", "int"),
    ("database_class", "string"),
    ("lambda_memory", "int"),
    ("task_cpu", "double"),
    ("task_memory", "int"),
    ("cache_node", "string"),
    ("search_instance", "string"),
    ("high_availability", "boolean"),
    ("backup_days", "int"),
]

_SMALL = ("t3.small", 1, 2, 1, "db.t3.micro", 512, 0.5, 1024, "cache.t3.micro", "t3.small.search", False, 1)
_MEDIUM = ("t3.medium", 1, 5, 2, "db.t3.small", 768, 1.0, 2048, "cache.t3.small", "t3.small.search", True, 7)
_LARGE = ("t3.large", 2, 10, 4, "db.t3.medium", 1024, 2.0, 4096, "cache.t3.medium", "t3.medium.search", True, 30)
_UNSET = ("t3.micro", 1, 3, 1, "db.t3.micro", 512, 0.5, 1024, "cache.t3.micro", "t3.small.search", False, 1)

SIZING_POLICY = [
    ("Development", *_SMALL),
    ("Integration", *_SMALL),
    ("Staging", *_MEDIUM),
    ("Production", *_LARGE),
]
SIZING_FALLBACK = "Development"

# what an application gets: staging takes the production row, production an empty override
SIZING_EFFECTIVE = [
    ("development", *_SMALL),
    ("integration", *_SMALL),
    ("staging", *_LARGE),
    ("production", *_UNSET),
]

# environment, key, value; the base flag comes from the production class of the environment
ENVIRONMENT_SETTINGS = [
    ("development", "EnableMockExternalServices", "True"),
    ("development", "UseLocalDatabase", "False"),
    ("development", "EnableDebugMode", "True"),
    ("development", "CacheEnabled", "False"),
    ("staging", "EnableMockExternalServices", "False"),
    ("staging", "UseProductionConfiguration", "True"),
    ("staging", "EnableStagingFeatures", "True"),
    ("staging", "CacheEnabled", "True"),
    ("staging", "EnableBlueGreenDeployment", "True"),
    ("production", "EnableMockExternalServices", "False"),
    ("production", "UseProductionConfiguration", "True"),
    ("production", "EnableHighAvailability", "True"),
    ("production", "CacheEnabled", "True"),
    ("production", "EnableDisasterRecovery", "True"),
    ("production", "EnableAdvancedMonitoring", "True"),
]
BASE_SETTINGS = [
    ("development", "EnableDetailedLogging", "True"),
    ("integration", "EnableDetailedLogging", "True"),
    ("staging", "EnableDetailedLogging", "False"),
    ("production", "EnableDetailedLogging", "False"),
]

# environment, enhanced monitoring, backup days
OVERRIDES = [
    ("Development", False, 1),
    ("Integration", False, 7),
    ("Staging", True, 7),
    ("Production", True, 30),
]
DEFAULT_MONITORING = False
DEFAULT_BACKUP_DAYS = 7

# scope column, scope value (null: any other), subject, rule, days
RETENTION = [
    ("account_type", "Production", "app_logs", "code", 30),
    ("account_type", "NonProduction", "app_logs", "code", 7),
    ("account_type", None, "app_logs", "code", 3),
    ("account_type", "Production", "shared_logs", "code", 30),
    ("account_type", None, "shared_logs", "code", 7),
    ("env_name", "Production", "backups", "sizing", 30),
    ("env_name", "Staging", "backups", "sizing", 7),
    ("env_name", None, "backups", "sizing", 1),
    ("env_name", "Development", "backups", "override", 1),
    ("env_name", "Production", "backups", "override", 30),
    ("env_name", None, "backups", "override", 7),
    ("env_name", None, "shared_database", "code", 7),
]

# environment, days of application log retention that the guide states
DOCUMENTED_LOG_DAYS = [
    ("Development", 7),
    ("Integration", 14),
    ("Staging", 30),
    ("Production", 90),
]

SUBSTITUTED_VARIABLES = [
    "ENVIRONMENT",
    "ACCOUNT_TYPE",
    "APP_VERSION",
    "AWS_REGION",
    "SERVICE_NAME",
    "TASK_DEFINITION_FAMILY",
    "LOG_GROUP_NAME",
]

# --- fixed values: containers and secrets ------------------------------------------------

PREFERRED_PORT = 8080
DEFAULT_CONTAINER = "app"
VALID_PROTOCOLS = ["tcp", "udp", "TCP", "UDP"]
BATCH_WORDS = [
    "cron",
    "job",
    "batch",
    "scheduler",
    "task",
    "worker",
    "processor",
    "cleanup",
    "backup",
    "sync",
]
HEALTH_INTERVAL, HEALTH_TIMEOUT, HEALTH_RETRIES, HEALTH_START = 30, 5, 3, 60
IMAGE_VERSION = "1.0.0"
NAMED_ENV_CONTAINER = "doc-nlp-service-web"
CONSTANT_SECRET = "test-secret"
IDENTITY_SECRETS = [
    "cognito-client-id",
    "cognito-client-secret",
    "cognito-user-pool-id",
    "cognito-domain",
]

# environment (null: any other), host prefix of the web host (null: no public host), local
REDIRECT_HOSTS = [
    ("production", "", False),
    ("staging", "stg-", False),
    ("development", "dev-", True),
    ("integration", "int-", True),
]
LOCAL_HOSTS = ["https://localhost:7015", "https://localhost:7243"]
CALLBACK_PATHS = ["/signin-oidc"]
LOGOUT_PATHS = ["", "/logout"]

# --- fixed values: requirements, tags, security groups -----------------------------------

# account types (null: every context), resource type, purpose, purpose text, validation rules, carries the tags
ROLE_REQUIREMENTS = [
    (None, "IamRole", "EcsTask", "ecs-task", ["CanAssumeEcsTasks", "HasS3Access"], True),
    (None, "IamRole", "EcsExecution", "ecs-exec", ["CanAssumeEcsTasks", "HasEcsExecutionPolicy"], True),
    (["Production"], "IamRole", "S3Access", "s3-access", ["HasS3Access"], False),
]

TASK_SERVICE = "ecs-tasks.amazonaws.com"
EXECUTION_POLICY = "AmazonECSTaskExecutionRolePolicy"

# group, direction, peer (group name or CIDR), protocol, from port, to port
SHARED_SG_RULES = [
    ("alb", "ingress", "0.0.0.0/0", "tcp", 80, 80),
    ("alb", "ingress", "0.0.0.0/0", "tcp", 443, 443),
    ("ecs", "ingress", "alb", "tcp", 0, 65535),
    ("ecs", "ingress", "ecs", "tcp", 8080, 8080),
    ("ecs", "egress", "0.0.0.0/0", "tcp", 80, 80),
    ("ecs", "egress", "0.0.0.0/0", "tcp", 443, 443),
    ("ecs", "egress", "alb", "tcp", 0, 65535),
    ("ecs", "egress", "vpc-endpoints", "tcp", 443, 443),
    ("rds", "ingress", "ecs", "tcp", 5432, 5432),
    ("rds", "ingress", "quicksight", "tcp", 5432, 5432),
    ("vpc-endpoints", "ingress", "ecs", "tcp", 443, 443),
    ("quicksight", "ingress", "rds", "tcp", 0, 65535),
    ("quicksight", "egress", "rds", "tcp", 5432, 5432),
    ("quicksight", "egress", "0.0.0.0/0", "tcp", 443, 443),
    ("quicksight", "egress", "0.0.0.0/0", "tcp", 80, 80),
]

# --- fixed values: stack outputs ---------------------------------------------------------

# stack, scope (env: {Env}-{suffix}; app: {Env}-{App}-{suffix}), suffix
STACK_EXPORTS = [
    ("base", "env", "vpc-id"),
    ("base", "env", "vpc-cidr"),
    ("base", "env", "vpc-azs"),
    ("base", "env", "public-subnet-ids"),
    ("base", "env", "private-subnet-ids"),
    ("base", "env", "isolated-subnet-ids"),
    ("base", "env", "sg-alb-id"),
    ("base", "env", "sg-ecs-id"),
    ("base", "env", "sg-rds-id"),
    ("base", "env", "sg-ecs-to-rds-id"),
    ("base", "env", "sg-vpc-endpoints-id"),
    ("base", "env", "sg-test-id"),
    ("base", "env", "sg-quicksight-id"),
    ("base", "env", "quicksight-website-vpc-endpoint-id"),
    ("base", "env", "quicksight-api-vpc-endpoint-id"),
    ("base", "env", "quicksight-embedding-vpc-endpoint-id"),
    ("base", "env", "shared-log-group-name"),
    ("base", "env", "shared-db-cluster-arn"),
    ("base", "env", "shared-db-endpoint"),
    ("base", "env", "shared-db-port"),
    ("base", "env", "shared-db-secret-arn"),
    ("alb", "app", "alb-arn"),
    ("alb", "app", "target-group-arn"),
    ("alb", "app", "alb-sg-id"),
    ("alb", "app", "ecs-sg-id"),
    ("alb", "app", "alb-dns"),
    ("cognito", "app", "user-pool-id"),
    ("cognito", "app", "user-pool-arn"),
    ("cognito", "app", "app-client-id"),
    ("cognito", "app", "app-client-secret"),
    ("cognito", "app", "cognito-domain-url"),
    ("cognito", "app", "cognito-domain-name"),
    ("data", "app", "documents-bucket-name"),
    ("data", "app", "app-bucket-name"),
    ("data", "app", "uploads-bucket-name"),
    ("data", "app", "backups-bucket-name"),
    ("ecs", "app", "task-definition-arn"),
    ("ecs", "app", "task-family"),
    ("ecs", "app", "service-name"),
    ("ecs", "app", "cluster-name"),
    ("ecs", "app", "task-role-arn"),
    ("ecs", "app", "execution-role-arn"),
]

# "provider" is the helper through which any stack looks up shared resources
STACK_IMPORTS = [
    ("provider", "env", "vpc-id"),
    ("provider", "env", "vpc-cidr"),
    ("provider", "env", "vpc-azs"),
    ("provider", "env", "public-subnet-ids"),
    ("provider", "env", "private-subnet-ids"),
    ("provider", "env", "isolated-subnet-ids"),
    ("provider", "env", "sg-alb-id"),
    ("provider", "env", "sg-ecs-id"),
    ("provider", "env", "sg-rds-id"),
    ("provider", "env", "sg-bastion-id"),
    ("provider", "env", "shared-log-group-name"),
    ("alb", "env", "sg-alb-id"),
    ("alb", "env", "sg-ecs-id"),
    ("alb", "env", "vpc-id"),
    ("alb", "env", "vpc-cidr"),
    ("alb", "env", "vpc-azs"),
    ("alb", "env", "public-subnet-ids"),
    ("alb", "env", "private-subnet-ids"),
    ("alb", "env", "isolated-subnet-ids"),
    ("ecs", "env", "vpc-id"),
    ("ecs", "env", "vpc-cidr"),
    ("ecs", "env", "vpc-azs"),
    ("ecs", "env", "public-subnet-ids"),
    ("ecs", "env", "private-subnet-ids"),
    ("ecs", "env", "isolated-subnet-ids"),
    ("ecs", "env", "sg-rds-id"),
    ("ecs", "app", "target-group-arn"),
    ("ecs", "app", "ecs-sg-id"),
    ("ecs", "app", "user-pool-id"),
    ("ecs", "app", "app-client-id"),
    ("ecs", "app", "cognito-domain-url"),
    ("ecs", "app", "cognito-domain-name"),
]

LIST_EXPORT_ITEMS = 3
SECRET_EXPORT_SUFFIX = "-secret-arn"

# --- fixed values: traffic and lifecycle -------------------------------------------------

# listener port, priority, path pattern, target
ROUTES = [
    (443, 100, "/app/*", "app"),
    (80, 100, "/app/*", "app"),
]
DEFAULT_TARGET = "app"
HEALTHY_COUNT, UNHEALTHY_COUNT = 2, 3

# class, days, stage
LIFECYCLE = [
    ("documents", 30, "infrequent_access"),
    ("documents", 90, "archive"),
    ("logs", 30, "expired"),
]

# queue, most receives before the message is set aside
QUEUE_LIMITS = [("processing", 3), ("urgent", 5)]
DEAD_LETTER_DAYS = 14
ROTATION_DAYS = 30


# --- tables ------------------------------------------------------------------------------


def environments(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "env_name string, env_prefix string, account_type string", ENVIRONMENTS)


def applications(spark: SparkSession, settings: Settings) -> DataFrame:
    return rule_table(spark, "app_name string, app_code string", list(settings.applications))


def regions(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "region string, region_code string", REGIONS)


def name_kinds(spark: SparkSession) -> DataFrame:
    return rule_table(
        spark,
        "kind string, template string, type_code string, family string, default_purpose string",
        NAME_KINDS,
    )


def name_limits(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "kind string, max_length int, pattern string", NAME_LIMITS)


def purposes(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "family string, purpose string, text string", PURPOSES)


def sizing(spark: SparkSession, effective: bool = False) -> DataFrame:
    columns = ", ".join(["env_name string"] + [f"{n} {t}" for n, t in SIZING_COLUMNS])
    return rule_table(spark, columns, SIZING_EFFECTIVE if effective else SIZING_POLICY)


def overrides(spark: SparkSession) -> DataFrame:
    return rule_table(
        spark, "env_name string, enhanced_monitoring boolean, backup_days int", OVERRIDES
    )


def role_requirements(spark: SparkSession) -> DataFrame:
    return rule_table(
        spark,
        "account_types strings, resource_type string, purpose string, purpose_text string, "
        "rules strings, tagged boolean",
        ROLE_REQUIREMENTS,
    )


def shared_sg_rules(spark: SparkSession) -> DataFrame:
    return rule_table(
        spark,
        "sg string, direction string, peer string, protocol string, from_port int, to_port int",
        SHARED_SG_RULES,
    )


def stack_exports(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "stack string, scope string, suffix string", STACK_EXPORTS)


def stack_imports(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "stack string, scope string, suffix string", STACK_IMPORTS)


def routes(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "port int, priority int, pattern string, target string", ROUTES)


def lifecycle(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "class string, days int, stage string", LIFECYCLE)


def queue_limits(spark: SparkSession) -> DataFrame:
    return rule_table(spark, "queue string, max_receives int", QUEUE_LIMITS)
