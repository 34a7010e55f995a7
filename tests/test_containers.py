"""Container rules, with nulls and empty lists kept apart."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import maps
from fleetlens.operators import containers, secrets
from fleetlens.plans import audits
from fleetlens.sources import documents


def docs(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return documents.parse_service_configs(spark.createDataFrame(rows, "doc_id int, text string"))


def task(*defs, name="main"):
    return {"ecsConfiguration": {"taskDefinition": [{"taskDefinitionName": name, "containerDefinitions": list(defs)}]}}


def container(name="web", image="repo:1", **more):
    return {"name": name, "image": image, **more}


def violations(spark, body):
    rows = containers.container_violations(docs(spark, body).drop("error")).collect()
    first = [r["message"] for r in rows if r["first"]]
    assert len(first) == (1 if rows else 0)
    return [r["message"] for r in rows]


HEAD = "Container 'web' has invalid port mapping: "


@pytest.mark.parametrize(
    "body, messages",
    [
        ({"ecsConfiguration": {"taskDefinition": []}}, ["At least one TaskDefinition configuration is required"]),
        (task(name=" "), ["TaskDefinitionName is required in the configuration"]),
        (task(), []),
        (task(container(name="")), ["Container name is required"]),
        (task(container(image=" ")), ["Container 'web' requires an image"]),
        (task(container(portMappings=[{"containerPort": 80}])), [HEAD + "Protocol is required"]),
        (task(container(portMappings=[{"containerPort": 80, "protocol": "Tcp"}])), [HEAD + "Protocol must be 'tcp' or 'udp', got 'Tcp'"]),
        (task(container(portMappings=[{"protocol": "tcp"}])), [HEAD + "ContainerPort must be a positive integer"]),
        (task(container(portMappings=[{"containerPort": 70000, "protocol": "UDP"}])), [HEAD + "ContainerPort must be <= 65535"]),
        (task(container(portMappings=[{"containerPort": 0, "protocol": ""}])), [HEAD + "ContainerPort must be a positive integer", HEAD + "Protocol is required"]),
        (task(container(secrets=["a"])), []),
        (task(container(secrets=[])), []),
        (task(container(secrets=None)), []),
    ],
)
def test_violations(spark, body, messages):
    assert violations(spark, body) == messages


def test_first_follows_the_order_of_tasks(spark):
    body = {
        "ecsConfiguration": {
            "taskDefinition": [
                {"taskDefinitionName": "a", "containerDefinitions": [container(), container(image="")]},
                {"taskDefinitionName": "", "containerDefinitions": None},
            ]
        }
    }
    assert violations(spark, body) == ["Container 'web' requires an image", "TaskDefinitionName is required in the configuration"]


def test_duplicates_within_one_task(spark):
    df = docs(spark, task(container("duplicate-name"), container("duplicate-name"), container("Duplicate-Name"), container(""), container("")))
    found = containers.duplicate_names(containers.explode_containers(df), ["doc_id", "task"]).collect()
    assert [(r["task"], r["name"], r["n"]) for r in found] == [("main", "duplicate-name", 2)]
    merged = audits.service_findings(df.drop("error")).filter("rule = 'duplicate_container'").collect()
    assert merged[0]["message"] == "Duplicate container names found in task 'main': duplicate-name"


def exploded(spark, *defs):
    return containers.explode_containers(docs(spark, task(*defs)))


@pytest.mark.parametrize(
    "defs, expected",
    [
        ([container("a"), container("b", portMappings=[{"containerPort": 90}]), container("c", portMappings=[{"containerPort": 8080}])], ("b", 90)),
        ([container("a", portMappings=[{"containerPort": 90}, {"containerPort": 8080}])], ("a", 8080)),
        ([container("a", portMappings=[]), container("b", portMappings=[{"hostPort": 1}])], ("a", 0)),
        ([], ("app", 8080)),
    ],
)
def test_primary_container(spark, defs, expected):
    row = containers.primary_container(exploded(spark, *defs), ["doc_id", "task_no"], ["pos"]).first()
    assert (row["primary_name"], row["primary_port"]) == expected


@pytest.mark.parametrize(
    "more, expected",
    [
        ({}, False),
        ({"name": "Nightly-CLEANUP"}, True),
        ({"portMappings": []}, True),
        ({"portMappings": None}, False),
        ({"essential": False}, True),
        ({"environment": [{"name": "MY_SCHEDULE", "value": "x"}]}, True),
        ({"environment": [{"name": "x", "value": "schedule"}]}, False),
        ({"environment": [{"name": "x", "value": "a CRON"}]}, True),
        ({"environment": [{"name": None, "value": None}]}, False),
    ],
)
def test_batch_jobs(spark, more, expected):
    flag = containers.is_batch_job(F.col("name"), F.col("portMappings"), F.col("environment"), F.col("essential"))
    assert exploded(spark, {**container(), **more}).select(flag).first()[0] is expected


STANDARD = "CMD-SHELL wget --no-verbose --tries=1 --spider http://localhost:8080{} || exit 1"


@pytest.mark.parametrize(
    "more, kind, command",
    [
        ({}, "standard", STANDARD.format("/health")),
        ({"disableHealthCheck": True}, "none", None),
        ({"essential": False, "healthCheck": {"command": ["x"]}}, "none", None),
        ({"healthCheck": {"command": ["CMD", "x"]}}, "custom", "CMD x"),
        ({"healthCheck": {"disabled": True, "command": ["CMD", "get http://localhost:8080/up now"]}}, "standard", STANDARD.format("/up")),
        ({"healthCheck": {"command": []}, "environment": [{"name": "HEALTH_CHECK_PATH", "value": "x"}]}, "standard", STANDARD.format("/health")),
        ({"environment": [{"name": "Health_Check_Path", "value": "x"}]}, "standard", STANDARD.format("/x")),
        ({"environment": [{"name": "HEALTH_CHECK_PATH", "value": " "}, {"name": "HEALTH_CHECK_PATH", "value": "/y"}]}, "standard", STANDARD.format("/health")),
    ],
)
def test_health_checks(spark, more, kind, command):
    row = containers.health_check(exploded(spark, {**container(), **more})).first()["health"]
    assert (row["kind"], row["command"]) == (kind, command)


def test_health_timing(spark):
    row = containers.health_check(exploded(spark, container(healthCheck={"command": ["x"], "interval": 9, "startPeriod": 1}))).first()["health"]
    assert (row["interval"], row["timeout"], row["retries"], row["start_period"]) == (9, 5, 3, 1)


def test_port_mappings(spark):
    ports = [
        {"containerPort": 80, "protocol": "TCP", "appProtocol": "https"}, {"containerPort": 81, "protocol": " "},
        {"protocol": "tcp"}, {"containerPort": 82, "hostPort": 1, "protocol": "udp", "appProtocol": "GRPC"},
    ]
    got = exploded(spark, container(portMappings=ports)).select(
        F.inline(containers.normalised_ports(F.col("name"), F.col("portMappings")))
    )
    assert [tuple(r) for r in got.collect()] == [("web-80-tcp", 80, None, "tcp", "http"), ("web-82-udp", 82, 1, "udp", "grpc")]


def test_container_environment(spark):
    env = [{"name": "PORT", "value": "1"}, {"name": "PORT", "value": "2"}, {"name": "", "value": "x"}, {"name": "E", "value": ""}]
    df = exploded(
        spark, container(environment=env), container("p", image="placeholder", environment=env),
        container("Doc-Nlp-Service-Web"),
    ).withColumns(
        {"env_name": F.lit("staging"), "account_type": F.lit("Production"), "region": F.lit("us-east-2"), "account_id": F.lit("1"), "app_name": F.lit("AppOne")}
    )
    got = {r["name"]: r["env_vars"] for r in containers.effective_env(df).collect()}
    assert got["web"]["PORT"] == "2" and "E" not in got["web"] and len(got["web"]) == 7
    assert got["p"]["PORT"] == "8080" and got["p"]["DEPLOYMENT_TYPE"] == "placeholder" and len(got["p"]) == 10
    assert got["Doc-Nlp-Service-Web"]["ASPNETCORE_ENVIRONMENT"] == "Staging"


def test_secret_names_and_identity_quirk(spark):
    variables = ["OpenAiOptions__ApiKey", "Cognito__ClientId", "Cognito__ClientSecret", "Cognito__UserPoolId", "Cognito__Domain"]
    df = spark.createDataFrame([(v,) for v in variables], "variable string")
    name = secrets.secret_name(F.col("variable"))
    got = [(r[0], r[1]) for r in df.select(name, secrets.is_identity_secret(name)).collect()]
    assert got == [
        ("openaioptions-apikey", False), ("cognito-clientid", False), ("cognito-clientsecret", False),
        ("cognito-userpoolid", False), ("cognito-domain", True),
    ]


def test_distinct_secrets_of_the_first_task(spark):
    body = {
        "ecsConfiguration": {
            "taskDefinition": [
                {"taskDefinitionName": "a", "containerDefinitions": [container(secrets=["x", "y"]), container(secrets=["x"])]},
                {"taskDefinitionName": "b", "containerDefinitions": [container(secrets=["z"])]},
            ]
        }
    }
    rows = containers.explode_containers(docs(spark, body))
    got = secrets.distinct_secrets(rows, ["doc_id"], F.col("task_no") == 0).collect()
    assert sorted(r["secret"] for r in got) == ["test-secret", "x", "y"]


def test_secret_plan_reports_collisions_and_failed_lookups(spark):
    requested = spark.createDataFrame([("/a", "A__B"), ("/a", "a-b"), ("/a", "A__B"), ("/c", "C"), ("/d", "D")], "path string, variable string")
    existing = spark.createDataFrame([("/a", True), ("/a", True), ("/c", False), ("/d", None)], "path string, lookup_ok boolean")
    got = {r["path"]: (r["action"], r["variables"], r["is_collision"], r["n_requests"]) for r in secrets.secret_plan(requested, existing).collect()}
    assert got == {"/a": ("import", ["A__B", "a-b"], True, 3), "/c": ("create", ["C"], False, 1), "/d": ("create", ["D"], False, 1)}
    late = requested.withColumn("no", F.when(F.col("variable") == "a-b", 1).when(F.col("variable") == "A__B", 2))
    served = {r["path"]: r["served_variable"] for r in secrets.secret_plan(late, existing, "no").collect()}
    assert served == {"/a": "a-b", "/c": "C", "/d": "D"}


def test_map_of_last(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, array(named_struct('k','a','v','1'), named_struct('k','b','v','2'), named_struct('k','a','v','3'))), "
        "(2, array(named_struct('k','a','v','1'))), (3, cast(array() AS array<struct<k:string,v:string>>)), (4, NULL) AS t(id, e)"
    )
    got = {r["id"]: r["m"] for r in maps.map_of_last(df, "m", F.col("e"), "k").collect()}
    assert got == {1: {"a": "3", "b": "2"}, 2: {"a": "1"}, 3: {}, 4: None}


def test_members_are_found_by_place(spark):
    """A member is looked up in a list of names, not by a function called for every member; the last spelling counts."""
    texts = [
        '{"ecsconfiguration":{"SERVICENAME":"first","serviceName":"last","serviceNAME":"mid",},}',
        '{"ecsConfiguration":{"serviceName":"a,]","taskDefinition":[{"taskDefinitionName":",}" ,"containerDefinitions":[{"cpu":"7",} , ],},]}}',
        '{"ecsConfiguration":{"serviceName":"a" , "vpc}',
    ]
    docs = documents.parse_service_configs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert "filter(" not in docs._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["service"], r["task"], r["cpu"]) for r in docs.orderBy("doc_id").selectExpr(
        "doc.ecsConfiguration.serviceName AS service", "doc.ecsConfiguration.taskDefinition[0].taskDefinitionName AS task",
        "doc.ecsConfiguration.taskDefinition[0].containerDefinitions[0].cpu AS cpu").collect()]
    assert got == [("last", None, None), ("a,]", ",}", 7), (None, None, None)]


def test_a_text_that_many_rows_hold_is_parsed_once(spark):
    texts = ['{"vpcNamePattern":"dev"}', json.dumps(task(container())), "{", '{"vpcNamePattern":"a"}', '{"vpcNamePattern":"a" }', None, ""]
    rows = spark.createDataFrame([(i, texts[i % 7]) for i in range(7 * 30)] + [(None, texts[1])] * 2, "doc_id int, text string").repartition(3)
    parsed = documents.parse_service_configs(rows)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("parseJson") and "Aggregate" in plan[plan.index("parseJson"):]
    alone = {t: documents.parse_service_configs(spark.createDataFrame([(0, t)], "doc_id int, text string")).collect()[0][1:] for t in texts}
    got = parsed.collect()
    assert sorted((r["doc_id"], *r[1:]) for r in got if r["doc_id"] is not None) == [(i, *alone[texts[i % 7]]) for i in range(7 * 30)]
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, *alone[texts[1]])] * 2
    assert [alone[t][1] for t in texts] == [None if t == texts[1] else "Invalid ECS configuration format" for t in texts]
