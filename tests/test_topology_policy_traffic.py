"""Stack order, policy evaluation and the rules over logs, against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions.text import matches, wildcard
from fleetlens.operators import policy, topology, traffic


def levels(spark, nodes, deps):
    n = spark.createDataFrame(nodes, "node string, declared_order int")
    d = spark.createDataFrame(deps, "node string, depends_on string")
    return {r["node"]: (r["level"], r["in_cycle"], r["order_violation"]) for r in topology.deploy_levels(n, d).collect()}


def test_levels_of_the_manifest(spark):
    got = levels(spark, [("alb", 1), ("ecs", 2), ("data", 3)], [("ecs", "alb")])
    assert got == {"alb": (0, False, False), "ecs": (1, False, False), "data": (0, False, False)}


def test_levels_diamond_cycle_and_order(spark):
    nodes = [(c, i) for i, c in enumerate("abcdefgh")]
    deps = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "a"), ("e", "f"), ("f", "e"), ("g", "f"), ("b", "h"), ("a", "outside")]
    got = levels(spark, nodes, deps)
    assert {n: got[n][0] for n in "abcdh"} == {"a": 0, "b": 1, "c": 1, "d": 2, "h": 0}
    assert {n: got[n][:2] for n in "efg"} == {"e": (None, True), "f": (None, True), "g": (None, False)}
    assert got["b"][2] and not got["c"][2] and got["e"][2]


def test_levels_of_random_graphs(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        n = 60
        edges = {(i, rnd.randrange(i)) for i in range(1, n) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))}
        edges |= {(50, 55), (55, 50)} if seed else set()
        dep = {}
        for a, b in edges:
            dep.setdefault(a, set()).add(b)
        want = {}

        def level(i, above=()):
            if i in above:
                return None
            if i not in want or above:
                own = [level(d, (*above, i)) for d in dep.get(i, ())]
                return None if None in own else 1 + max(own, default=-1)
            return want[i]

        want = {i: level(i) for i in range(n)}
        got = levels(spark, [(str(i), i) for i in range(n)], [(str(a), str(b)) for a, b in edges] + [("1", None)])
        assert {int(k): v[0] for k, v in got.items()} == want


def test_a_long_chain_takes_logarithmic_rounds(spark, caplog):
    nodes = spark.range(3000).selectExpr("CAST(id AS string) AS node", "CAST(id AS int) AS declared_order")
    deps = spark.range(1, 3000).selectExpr("CAST(id AS string) AS node", "CAST(id - 1 AS string) AS depends_on")
    with caplog.at_level("INFO"):
        rows = topology.deploy_levels(nodes, deps).collect()
    assert all(int(r["node"]) == r["level"] for r in rows) and len(rows) == 3000
    assert "chains collapsed in 13 rounds" in caplog.text and "joins settled in 0 rounds" in caplog.text


def components_by_brute_force(n, edges):
    """Nodes that reach each other, by closure; the least of those that share a cycle with each node."""
    reach = [{b for a, b in edges if a == i} for i in range(n)]
    for k in range(n):
        for i in range(n):
            if k in reach[i]:
                reach[i] |= reach[k]
    return {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n) if i in reach[i]}


@pytest.mark.parametrize("most, seeds", [(8, 1), (1000, 3)])
def test_cycles_of_random_graphs(spark, most, seeds):
    for seed in range(seeds):
        rnd = random.Random(seed)
        n = 30
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(n + 10 * seed)} | {(0, 0)}
        want = components_by_brute_force(n, edges)
        deps = spark.createDataFrame([*edges, (1, None), (2, 99)], "node int, depends_on int")
        nodes = spark.range(n).selectExpr("CAST(id AS int) AS node", "1 AS declared_order")
        rows = {r["node"]: r for r in topology.deploy_levels(nodes, deps, most).collect()}
        assert {i: r["cycle_id"] for i, r in rows.items() if r["in_cycle"]} == want
        assert all((r["level"] is None) == (r["in_cycle"] or r["behind_cycle"]) and not (r["in_cycle"] and r["behind_cycle"]) for r in rows.values())


def test_a_ladder_takes_few_rounds(spark, caplog):
    """Each of 4,000 nodes depends on the two before; a cycle of 600 nodes with chords stands behind it, and a tail behind that."""
    n = 4_000
    ladder = spark.range(n).selectExpr("id AS node", "explode(array(id - 1, id - 2)) AS depends_on").filter("depends_on >= 0")
    ring = spark.range(600).selectExpr(f"{n} + id AS node", f"explode(array({n} + (id + 1) % 600, {n} + (id + 2) % 600, 5)) AS depends_on")
    tail = spark.range(100).selectExpr("20000 + id AS node", f"explode(array(19999 + id, if(id = 0, {n}, 20000 + id - 2))) AS depends_on")
    deps = ladder.union(ring).union(tail)
    nodes = deps.select("node").union(deps.select("depends_on")).distinct().withColumn("declared_order", F.lit(1))
    with caplog.at_level("INFO"):
        rows = {r["node"]: r for r in topology.deploy_levels(nodes, deps, most=1500).collect()}
    assert all(rows[i]["level"] == i for i in range(n))
    assert all(rows[n + i]["cycle_id"] == n for i in range(600))
    assert all(rows[20_000 + i]["behind_cycle"] for i in range(100))
    assert max(int(k) for k in re.findall(r"(?:collapsed|settled|spread) in (\d+) rounds", caplog.text)) < 20
    assert int(re.search(r"joins settled in (\d+) rounds", caplog.text)[1]) <= 8


def stacks(spark):
    return spark.createDataFrame([("Development", "AppOne")], "env_name string, app_name string")


def test_only_the_bastion_group_is_never_exported(spark):
    missing = topology.unresolved_imports(topology.expected_imports(stacks(spark)), topology.expected_exports(stacks(spark)), ["name"])
    assert [r["name"] for r in missing.collect()] == ["Development-sg-bastion-id"]
    assert topology.duplicate_exports(topology.expected_exports(stacks(spark)), ["name"]).count() == 0


def test_undeclared_dependencies(spark):
    imports = topology.expected_imports(stacks(spark)).filter("stack <> 'provider'").select("name", "stack")
    exports = topology.expected_exports(stacks(spark)).select("name", "stack")
    declared = spark.createDataFrame([("ecs", "alb")], "stack string, depends_on string")
    pairs = lambda ex: sorted(tuple(r) for r in topology.undeclared_dependencies(imports, ex, declared, ["name"]).collect())
    assert pairs(exports) == [("alb", "base"), ("ecs", "base"), ("ecs", "cognito")]
    assert pairs(exports.filter("stack <> 'base'")) == [("ecs", "cognito")]


def test_list_items(spark):
    df = spark.createDataFrame([(1, "a,b,c"), (2, "a"), (3, None)], "id int, joined string")
    rows = topology.list_import_items(df)
    assert rows.filter("id = 1 AND size_ok").count() == 3 and rows.filter("id = 2 AND NOT size_ok").count() == 1
    assert [tuple(r) for r in rows.filter("id = 3").collect()] == [(3, None, None, None, None)]
    assert {tuple(r) for r in topology.join_list_export(rows, ["id"]).collect()} == {(1, "a,b,c"), (2, "a"), (3, None)}


def test_secret_exports(spark):
    df = spark.createDataFrame([("Development", "AppOne", "key")] * 2, "env_name string, app_name string, secret_name string")
    assert [r["name"] for r in topology.secret_exports(df).collect()] == ["Development-AppOne-key-secret-arn"]


@pytest.mark.parametrize(
    "pattern, value, hit",
    [
        ("*", "", True), ("*", "a/b", True), ("a*", "a", True), ("a*", "b", False), ("a?c", "abc", True), ("a?c", "ac", False),
        ("a.c", "abc", False), ("a.c", "a.c", True), ("a+(b)[c]{d}^$|\\*", "a+(b)[c]{d}^$|\\xyz", True), ("*/x", "a/b/x", True),
        ("*/x", "a/b/xy", False), ("a*b*c", "a--b--c", True), ("", "", True), ("", "a", False), ("a*", "A", False), ("a*\n?", "ab\nc", True),
        ("a*a", "a", False), ("a*a", "aa", True), ("*b*b*", "abcb", True), ("*b*b*", "abc", False), ("**", "x", True), ("ab*bc", "abc", False),
        ("a**c", "ac", True), ("*é*", "aéb", True),
    ],
)
def test_wildcards(spark, pattern, value, hit):
    df = spark.createDataFrame([(pattern, value)], "p string, v string")
    assert df.select(matches(F.col("v"), wildcard(F.col("p")))).first()[0] is hit
    assert df.select(matches(F.lit(None).cast("string"), wildcard(F.col("p")))).first()[0] is False


def glob(pattern, value):
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return re.fullmatch(body, value, re.S) is not None


def decide(request, statements):
    hits = [
        s for s in statements
        if s["principal"] == request["principal"] and glob(s["action"].lower(), request["action"].lower()) and glob(s["resource"], request["resource"])
        and all(
            any(v == p if op == "StringEquals" else glob(p, v) for v in request["context"].get(key, []) for p in patterns)
            for op, key, patterns in s["conditions"]
        )
    ]
    deny = sorted(s["sid"] for s in hits if s["effect"] == "Deny")
    allow = sorted(s["sid"] for s in hits if s["effect"] == "Allow")
    return ("explicit_deny", deny[0]) if deny else ("allow", allow[0]) if allow else ("implicit_deny", None)


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(7)
    actions = ["s3:GetObject", "s3:PutObject", "kms:Decrypt", "S3:getobject", "iam:PassRole"]
    requests = [
        {
            "request_id": i, "principal": f"p{rnd.choice([0, 0, 0, 1, 2])}", "action": rnd.choice(actions), "resource": rnd.choice(["/dev/a", "/dev/b.c", "/prod/a"]),
            "context": {k: [v] for k, v in [("via", "x.us"), ("tag", rnd.choice(["dev-1", "qa-2"]))] if rnd.random() < 0.7},
        }
        for i in range(300)
    ]
    conditions = [[], [], [("StringEquals", "via", ["x.us"])], [("StringLike", "tag", ["dev-*", "z"]), ("ForAnyValue:StringLike", "via", ["?.us"])], [("StringEquals", "tag", ["dev-*"])]]
    statements = [
        {
            "principal": f"p{rnd.randrange(3)}", "sid": f"s{i:02d}", "effect": rnd.choice(["Allow", "Allow", "Deny"]),
            "action": rnd.choice(["s3:*", "s3:Get*", "*", "k*:Decrypt", "kms:Decrypt", "iam:?assRole", "S3:PutObject"]),
            "resource": rnd.choice(["*", "/dev/*", "/*/a", "/dev/b.c", "/prod/?"]), "conditions": rnd.choice(conditions),
        }
        for i in range(24)
    ]
    return requests, statements


def test_evaluation_matches_brute_force(spark, cases):
    requests, statements = cases
    r = spark.createDataFrame(
        [(q["request_id"], q["principal"], q["action"], q["resource"], q["context"]) for q in requests],
        "request_id int, principal string, action string, resource string, context map<string,array<string>>",
    )
    s = spark.createDataFrame(
        [(x["principal"], x["sid"], x["effect"], x["action"], x["resource"], x["conditions"]) for x in statements],
        "principal string, sid string, effect string, action string, resource string, conditions array<struct<op:string,key:string,patterns:array<string>>>",
    )
    got = {x["request_id"]: (x["decision"], x["matched_sid"]) for x in policy.evaluate(r, s, ["principal"]).collect()}
    assert got == {q["request_id"]: decide(q, statements) for q in requests}
    assert len({d for d, _ in got.values()}) == 3


def test_ids_play_no_part_in_decisions(spark):
    r = spark.createDataFrame(
        [(1, "p", "s3:Get", "a"), (1, "p", "s3:Put", "a"), (None, "p", "s3:Get", "a"), (None, "p", None, "a"), (2, None, "s3:Get", "a")],
        "request_id int, principal string, action string, resource string",
    )
    s = spark.createDataFrame([("p", "x", "Allow", "s3:Get", "*"), (None, "y", "Allow", "*", "*")], "principal string, sid string, effect string, action string, resource string")
    got = sorted(((x["request_id"] or 0, x["action"] or "", x["decision"]) for x in policy.evaluate(r, s, ["principal"]).collect()))
    assert got == [(0, "", "implicit_deny"), (0, "s3:Get", "allow"), (1, "s3:Get", "allow"), (1, "s3:Put", "implicit_deny"), (2, "s3:Get", "implicit_deny")]


def test_denies_that_cannot_be_judged_and_spared_parts(spark):
    s = spark.sql(
        """SELECT * FROM VALUES
        ('All', 'Allow', array('s3:*', 'kms:*'), NULL, array('*'), NULL, NULL),
        ('Odd', 'Deny', array('s3:Put'), NULL, array('*'), NULL, array(named_struct('op','StringNotEquals','key','k','patterns',array('v')))),
        ('Other', 'Deny', NULL, array('s3:*', 'kms:Decrypt'), array('*'), NULL, NULL),
        ('Place', 'Deny', array('s3:*'), NULL, NULL, array('/dev/*', '/stg/*'), NULL)
        AS t(sid, effect, actions, not_actions, resources, not_resources, conditions)"""
    ).withColumn("principal", F.lit("p"))
    r = spark.createDataFrame(
        [(1, "s3:Get", "/dev/a"), (2, "s3:Put", "/dev/a"), (3, "kms:Encrypt", "/dev/a"), (4, "kms:Decrypt", "/x"), (5, "s3:Put", "/prod/a")],
        "id int, action string, resource string",
    ).withColumn("principal", F.lit("p"))
    got = {x["id"]: (x["decision"], x["matched_sid"]) for x in policy.evaluate(r, policy.flatten_statements(s), ["principal"]).collect()}
    assert got == {1: ("allow", "All"), 2: ("undetermined", "Odd"), 3: ("explicit_deny", "Other"), 4: ("allow", "All"), 5: ("explicit_deny", "Place")}


def test_statements_without_resource_stay(spark):
    s = spark.sql("SELECT 't' AS sid, array('sts:AssumeRole') AS actions, CAST(NULL AS array<string>) AS resources")
    assert [tuple(r) for r in policy.flatten_statements(s).collect()] == [("t", "sts:AssumeRole", None)]


def test_deny_alone_never_allows(spark, cases):
    requests, statements = cases
    r = spark.createDataFrame([(q["request_id"], q["principal"], q["action"], q["resource"]) for q in requests], "request_id int, principal string, action string, resource string")
    s = spark.createDataFrame([(x["principal"], x["sid"], "Deny", x["action"], x["resource"]) for x in statements], "principal string, sid string, effect string, action string, resource string")
    assert policy.evaluate(r, s, ["principal"]).filter("decision = 'allow'").count() == 0


def test_isolation_rules_keep_environments_apart(spark):
    contexts = spark.createDataFrame(
        [("Development", "AppOne", "us-east-2", "1"), ("Production", "AppOne", "us-east-2", "1")],
        "env_name string, app_name string, region string, account_id string",
    )
    statements = policy.flatten_statements(policy.isolation_rules(contexts).withColumn("principal", F.col("env_name")))
    arn = "arn:aws:secretsmanager:us-east-2:1:secret:/{}/appone/key"
    requests = spark.createDataFrame(
        [
            (1, "Development", "secretsmanager:GetSecretValue", arn.format("development"), {"secretsmanager:SecretId": ["/development/appone/key"]}),
            (2, "Development", "secretsmanager:GetSecretValue", arn.format("production"), {"secretsmanager:SecretId": ["/production/appone/key"]}),
            (3, "Production", "kms:Decrypt", "k", {"kms:ViaService": ["secretsmanager.us-east-2.amazonaws.com"]}),
            (4, "Production", "kms:Decrypt", "k", {}),
        ],
        "request_id int, principal string, action string, resource string, context map<string,array<string>>",
    )
    got = {r["request_id"]: r["decision"] for r in policy.evaluate(requests, statements, ["principal"]).collect()}
    assert got == {1: "allow", 2: "explicit_deny", 3: "allow", 4: "implicit_deny"}


def test_unsupported_condition_operators_are_listed(spark):
    s = spark.sql("SELECT 's' AS sid, array(named_struct('op','IpAddress','key','k','patterns',array('x')), named_struct('op','StringLike','key','j','patterns',array('y'))) AS conditions")
    assert [tuple(r) for r in policy.unsupported_conditions(s).collect()] == [("s", "IpAddress", "k")]


def test_policy_checks_and_strict_arrays(spark):
    s = spark.createDataFrame(
        [("a", ["x:Get"], False, ["/dev/1"], True, "Allow"), ("b", None, False, None, False, None)],
        "policy string, actions array<string>, action_is_array boolean, resources array<string>, resource_is_array boolean, effect string",
    )
    lax = {r["policy"]: tuple(r)[1:] for r in policy.policy_checks(s, ["policy"], ["x:Get", "y"], "/dev/").collect()}
    strict = {r["policy"]: tuple(r)[1:] for r in policy.policy_checks(s, ["policy"], ["x:Get", "y"], "/dev/", strict_arrays=True).collect()}
    assert lax == {"a": (True, False, True, False), "b": (False, False, False, False)}
    assert strict["a"] == (False, False, True, False)


def test_trust_reports_every_pattern_that_matched(spark):
    subjects = spark.createDataFrame([("aud", "r:ref:refs/heads/main"), ("aud", "r:pull_request"), ("x", "r:pull_request")], "audience string, subject string")
    trust = spark.createDataFrame([("dev", "aud", "r:ref:refs/heads/*"), ("dev", "aud", "r:ref:refs/heads/main"), ("dev", "aud", "r:pull_request")], "role string, audience string, pattern string")
    got = sorted(tuple(r)[1:] for r in policy.trust_matches(subjects, trust).collect())
    assert got == [("r:pull_request", "dev", "r:pull_request"), ("r:ref:refs/heads/main", "dev", "r:ref:refs/heads/*"), ("r:ref:refs/heads/main", "dev", "r:ref:refs/heads/main")]


KNOWN = {"StringEquals", "StringLike", "ForAnyValue:StringLike"}


def trust_by_brute_force(document, audience, subject):
    """False, None (unknown) or True for each statement; the decision, or nothing if none may allow."""
    seen = set()
    for s in document["Statement"]:
        actions = s["Action"] if isinstance(s["Action"], list) else [s["Action"]]
        if "Principal" not in s or not any(glob(a.lower(), "sts:assumerolewithwebidentity") for a in actions):
            continue
        verdict = True
        for op, tests in s.get("Condition", {}).items():
            for key, patterns in tests.items():
                patterns = patterns if isinstance(patterns, list) else [patterns]
                value = {"aud": audience, "sub": subject}.get(key.split(":")[-1])
                if op not in KNOWN or value is None:
                    one = None
                else:
                    one = any(p == value if op == "StringEquals" else glob(p, value) for p in patterns)
                verdict = False if False in (verdict, one) else None if None in (verdict, one) else True
        seen.add((s["Effect"], verdict))
    if not {("Allow", True), ("Allow", None)} & seen:
        return None
    for case, said in ((("Deny", True), "explicit_deny"), (("Deny", None), "undetermined"), (("Allow", True), "allow")):
        if case in seen:
            return said
    return "undetermined"


def test_trust_decisions_by_brute_force(spark):
    from fleetlens.sources import documents

    rnd = random.Random(5)
    pieces = ["repo:org/", "repo:evil/", "app:", "*", "ref:refs/heads/", "main", "?", "pull_request", "feature/a-long-name-of-a-branch-"]
    texts = {}
    for i in range(120):
        statements = []
        for _ in range(rnd.randrange(1, 4)):
            s = {"Effect": rnd.choice(["Allow", "Allow", "Deny"]), "Action": rnd.choice(["sts:AssumeRoleWithWebIdentity", ["sts:*"], "*", "s3:*", ["a:b", "STS:assume*identity"]])}
            if rnd.random() < 0.9:
                s["Principal"] = {"Federated": "f"}
            condition = {}
            for _ in range(rnd.randrange(4)):
                op = rnd.choice([*KNOWN, *KNOWN, "StringNotLike", "ForAllValues:StringLike", "StringEqualsIgnoreCase"])
                key = rnd.choice(["t:aud", "t:sub", "t:sub", "t:sub", "t:owner"]) if rnd.random() < 0.9 else "t:aud"
                patterns = rnd.choice([["aud"], ["a*", "x"]]) if key == "t:aud" else ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 4))]
                condition.setdefault(op, {})[key] = patterns if len(patterns) > 1 or rnd.random() < 0.5 else patterns[0]
            if condition:
                s["Condition"] = condition
            statements.append(s)
        texts[f"role{i}"] = {"Statement": statements}
    subjects = {(rnd.choice(["aud", "abc", "no"]), "".join(rnd.choice(pieces[:3] + pieces[4:]) for _ in range(rnd.randrange(1, 6))).replace("?", "x")) for _ in range(150)}
    rows = documents.parse_policies(spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "policy_id string, text string"))
    asked = spark.createDataFrame([*subjects, *subjects, (None, None), ("aud", None)], "audience string, subject string")
    got = {(r["audience"], r["subject"], r["role"]): r["decision"] for r in policy.trust_decisions(asked, rows, "policy_id").filter("subject IS NOT NULL").collect()}
    want = {(a, s, k): trust_by_brute_force(v, a, s) for k, v in texts.items() for a, s in subjects}
    assert got == {k: v for k, v in want.items() if v}
    assert {"explicit_deny", "undetermined", "allow"} == set(got.values())


def test_an_excluded_subject_is_never_let_in(spark):
    """Documents that name a subject only in conditions that are not understood, or deny it."""
    from fleetlens.sources import documents

    allow = {"Effect": "Allow", "Principal": {"Federated": "f"}, "Action": "sts:AssumeRoleWithWebIdentity"}
    aud = {"StringEquals": {"t:aud": "aud"}}
    sample = {
        "not_like": [allow | {"Condition": aud | {"StringNotLike": {"t:sub": "repo:evil/*"}}}],
        "all_values": [allow | {"Condition": aud | {"ForAllValues:StringLike": {"t:sub": "repo:org/app:*"}}}],
        "ignore_case": [allow | {"Condition": aud | {"StringEqualsIgnoreCase": {"t:sub": "repo:org/app:main"}}}],
        "owner": [allow | {"Condition": {"StringEquals": {"t:aud": "aud", "t:repository_owner": "org"}}}],
        "denied": [allow | {"Condition": aud}, {"Effect": "Deny", "Principal": "*", "Action": "sts:*", "Condition": {"StringLike": {"t:sub": "repo:evil/*"}}}],
        "both": [allow | {"Condition": {"StringEquals": {"t:sub": "repo:org/app:main"}, "StringLike": {"t:sub": "repo:other/*"}}}],
        "named": [allow | {"Condition": aud | {"StringLike": {"t:sub": "repo:org/*"}}}],
        "open": [allow | {"Condition": aud}],
    }
    texts = [(k, json.dumps({"Statement": v})) for k, v in sample.items()]
    rows = documents.parse_policies(spark.createDataFrame(texts, "policy_id string, text string"))
    subjects = spark.createDataFrame([("aud", "repo:evil/x:main"), ("aud", "repo:org/app:main")], "audience string, subject string")
    got = {(r["subject"][5:8], r["role"]): (r["decision"], r["patterns"]) for r in policy.trust_decisions(subjects, rows, "policy_id").collect()}
    unknown = {(who, role): ("undetermined", []) for who in ("evi", "org") for role in ("not_like", "all_values", "ignore_case", "owner")}
    assert got == unknown | {
        ("evi", "denied"): ("explicit_deny", ["repo:evil/*"]), ("org", "denied"): ("allow", []), ("org", "named"): ("allow", ["repo:org/*"]),
        ("evi", "open"): ("allow", []), ("org", "open"): ("allow", []),
    }


def test_patterns_are_shown_once_for_a_class_of_roles(spark):
    """What is made of the patterns lies below the last join, and its rows are as made after it."""
    from fleetlens.sources import documents

    likes = {"StringLike": {"t:sub": ["repo:org/*", "*:main"]}}
    allow = {"Effect": "Allow", "Principal": {"Federated": "f"}, "Action": "sts:AssumeRoleWithWebIdentity"}
    texts = [(i, json.dumps({"Statement": [allow | {"Condition": likes}]})) for i in range(9)]
    rows = documents.parse_policies(spark.createDataFrame(texts, "policy_id int, text string"))
    subjects = spark.createDataFrame([("aud", "repo:org/app:main"), ("aud", "repo:org/b"), ("aud", "no")], "audience string, subject string")
    found = policy.trust_decisions(subjects, rows, "policy_id", shown=lambda c: F.array_join(c, ","))
    want = policy.trust_decisions(subjects, rows, "policy_id").withColumn("patterns", F.array_join("patterns", ","))
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() == 18
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in text and "array_join" not in text[: text.index("Join")]
    assert "Scan ExistingRDD" not in found.select("role")._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD[audience", "").replace("Scan ExistingRDD[policy_id", "")


def test_roles_with_the_same_documents_are_judged_once(spark, monkeypatch):
    from fleetlens.sources import documents

    met, meet = [], policy._meet
    monkeypatch.setattr(policy, "_meet", lambda *a: met.append(meet(*a)) or met[-1])
    allow = {"Effect": "Allow", "Principal": {"Federated": "f"}, "Action": "sts:AssumeRoleWithWebIdentity"}
    deny = {"Effect": "Deny", "Principal": "*", "Action": "sts:*", "Condition": {"StringLike": {"t:sub": "repo:b*"}}}
    texts = [json.dumps({"Statement": v}) for v in ([allow | {"Sid": "x"}], [allow, deny], [deny, allow], [deny], [allow | {"Condition": {"Odd": {"t:sub": "a"}}}])]
    rows = documents.parse_policies(spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "policy_id int, text string"))
    subjects = spark.createDataFrame([("aud", f"repo:{x}{i}") for x in "ab" for i in range(20)] * 2, "audience string, subject string")
    got = policy.trust_decisions(subjects, rows, "policy_id").collect()
    want = []
    for role in range(100):
        for x in "ab":
            denied = ("explicit_deny", ["repo:b*"]) if x == "b" else ("allow", [])
            said = [("allow", []), denied, denied, None, ("undetermined", [])][role % 5]
            want += [(f"repo:{x}{i}", role, *said) for i in range(20) if said]
    assert sorted((r["subject"], r["role"], r["decision"], r["patterns"]) for r in got) == sorted(want)
    assert met[0].count() <= 40 * 5


def test_a_principal_with_many_statements_meets_few(spark):
    """Statements are filed under a beginning: the join is an equi-join on it and gives few rows."""
    n = 100_000
    s = spark.range(n).selectExpr(
        "'p' AS principal", "concat('s', id) AS sid", "if(id % 7 = 0, 'Deny', 'Allow') AS effect", "if(id % 3 = 0, 's3:Get*', 's3:GetObject') AS action",
        "concat('arn:aws:s3:::bucket-', lpad(id, 6, '0'), if(id % 2 = 0, '/*', '/key')) AS resource",
    )
    asked = [(i, "p", "s3:getobject", f"arn:aws:s3:::bucket-{i * 37 % n:06d}/{'key' if i % 4 else 'other'}") for i in range(400)]
    requests = spark.createDataFrame([*asked, (None, "p", "s3:PutObject", "arn:aws:s3:::bucket-000001/key"), (None, "q", "s3:GetObject", "x")], "id int, principal string, action string, resource string")
    found = policy.evaluate(requests, s, ["principal"])
    want = {}
    for i, _, _, resource in asked:
        no, key = int(resource[20:26]), resource.endswith("key")
        hit = no % 2 == 0 or key
        want[i] = (("explicit_deny" if no % 7 == 0 else "allow"), f"s{no}") if hit else ("implicit_deny", None)
    assert {r["id"]: (r["decision"], r["matched_sid"]) for r in found.filter("id IS NOT NULL").collect()} == want
    assert {r["decision"] for r in found.filter("id IS NULL").collect()} == {"implicit_deny"}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*_at_action_key.*_at_resource_key", text)


def test_a_frequent_question_is_spread(spark):
    s = spark.createDataFrame([("p", "ok", "Allow", "a:*", "*")], "principal string, sid string, effect string, action string, resource string")
    requests = spark.range(20_000).selectExpr("id", "'p' AS principal", "'a:b' AS action", "if(id % 2 = 0, '/x', cast(null AS string)) AS resource")
    got = policy.evaluate(requests, s, ["principal"]).groupBy("decision", "matched_sid").count().collect()
    assert sorted(map(tuple, got)) == [("allow", "ok", 10_000), ("implicit_deny", None, 10_000)]


def test_routes_by_brute_force(spark):
    rnd = random.Random(3)
    paths = ["/" + "/".join(rnd.choice(["a", "b", "ab", "x1"]) for _ in range(rnd.randrange(4))) for _ in range(60)] + ["", "a", None]
    requests = [(rnd.randrange(5), rnd.choice([80, 443, None]), p) for p in paths]
    table = [
        (rnd.choice([80, 443]), rnd.choice([1, 2, 2, None]), "".join(rnd.choice(["/", "a", "b", "*", "/a", "/?", "x1"]) for _ in range(rnd.randrange(1, 6))), f"t{i}")
        for i in range(80)
    ]
    want = []
    for i, port, path in requests:
        hits = [(p is None, p or 0, t) for o, p, g, t in table if o == port and path is not None and glob(g, path)]
        want.append((i, port or 0, path or "", min(hits)[2] if hits else "app"))
    r = spark.createDataFrame(requests, "id int, port int, path string")
    s = spark.createDataFrame(table, "port int, priority int, pattern string, target string")
    got = [(x["id"], x["port"] or 0, x["path"] or "", x["target"]) for x in traffic.route(r, s).collect()]
    assert sorted(got) == sorted(want) and len({x[3] for x in got}) > 5


def test_a_folder_of_many_routes_shares_no_key(spark):
    """Rules of one folder, with and without a wildcard before what tells them apart."""
    numbers = spark.range(100, 4100).withColumn("tail", F.element_at(F.array(*map(F.lit, ["", "*", ".h*l", "/*", "?html"])), F.expr("cast(id % 5 AS int) + 1")))
    pattern = F.concat(F.lit("/en/"), F.when(F.col("id") % 3 == 0, "*").otherwise(""), "id", "tail")
    table = numbers.select(F.lit(80).alias("port"), F.lit(None).cast("int").alias("priority"), pattern.alias("pattern"), F.format_string("t%05d", "id").alias("target"))
    assert traffic._filed_rules(table).groupBy("kind", "text").count().agg(F.max("count")).first()[0] <= 2
    requests = spark.createDataFrame([("/en/1000",), ("/en/1001/x",), ("/en/1002.html",), ("/en/2222.html",), ("/en/99",)], "path string").withColumn("port", F.lit(80))
    want = {"/en/1000": "t01000", "/en/1001/x": "t01001", "/en/1002.html": "t01002", "/en/2222.html": "t00222", "/en/99": "app"}
    assert {r["path"]: r["target"] for r in traffic.route(requests, table).collect()} == want


def test_what_paths_look_up_is_not_broadcast(spark, tmp_path):
    """A path looks up many parts, so a small table of requests is not small then, nor are the parts of the rules."""
    spark.createDataFrame([(f"/en/{i}",) for i in range(50)], "path string").selectExpr("path", "80 AS port").write.parquet(f"{tmp_path}/requests")
    requests = spark.read.parquet(f"{tmp_path}/requests")
    table = spark.range(200_000).selectExpr("80 AS port", "1 AS priority", "concat('/en/', id, '/*') AS pattern", "'t' AS target").crossJoin(spark.range(5).select())
    text = traffic.route(requests, table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text.split("Cross")[0] and text.count("SortMergeJoin") >= 2 and "Scan ExistingRDD" not in text


def test_the_rarest_part_is_found_beyond_equal_and_long_ones(spark):
    """A pattern with many wildcards, parts longer than are counted, and rules that come twice."""
    long = "x" * 1500
    table = [(80, 1, "/a/*b?c*" + "*".join(f"p{i}" for i in range(40)) + "*", "many")] * 2 + [(80, 2, f"/a/{long}*", "long"), (80, 3, f"/a/{long}", "whole"), (80, 4, "*", "any"), (80, 4, "*", "also")]
    requests = [("/a/1bxc" + "-".join(f"p{i}" for i in range(40)), "many"), (f"/a/{long}", "long"), (f"/a/{long}y", "long"), ("/a/x", "also"), ("", "also")]
    s = spark.createDataFrame(table, "port int, priority int, pattern string, target string")
    got = traffic.route(spark.createDataFrame([(80, p) for p, _ in requests], "port int, path string"), s).collect()
    assert {r["path"]: r["target"] for r in got} == dict(requests)
    assert traffic._filed_rules(s).count() == 4


def test_routes_take_the_lowest_priority(spark):
    requests = spark.createDataFrame([(1, 443, "/app/x"), (2, 80, "/app"), (3, 443, "/APP/x"), (4, 8443, "/app/x"), (5, 443, "/app/v2/y")], "id int, port int, path string")
    table = rules.routes(spark).withColumn("target", F.lit("service")).unionByName(
        rules.rule_table(spark, "port int, priority int, pattern string, target string", [(443, 5, "/app/v?/*", "second"), (443, 200, "*", "last")])
    )
    got = {r["id"]: r["target"] for r in traffic.route(requests, table, default="none").collect()}
    assert got == {1: "service", 2: "none", 3: "last", 4: "none", 5: "second"}


def states(rows, up, down):
    state, streak, last, out = "unknown", 0, None, {}
    for ts, event, ok in sorted(rows):
        streak = streak + 1 if ok == last else 1
        last = ok
        if ok and streak >= up:
            state = "healthy"
        if not ok and streak >= down:
            state = "unhealthy"
        out[event] = state
    return out


@pytest.mark.parametrize("up, down, slices, share", [(2, 3, None, 0.5), (2, 3, 40, 0.8), (5, 7, 7, 0.85), (1, 1, 1, 0.5), (40, 30, 40, 0.99)])
def test_health_states_match_a_plain_scan(spark, up, down, slices, share):
    rnd = random.Random(up * 100 + down)
    rows, ok = [], True
    for i in range(1500):
        ok = ok if rnd.random() < share else not ok
        target = 0 if rnd.random() < 0.9 else rnd.randrange(1, 6)
        rows.append((target, 1_700_000_000 + rnd.randrange(20_000) if i % 3 else 1_700_000_000 + (i // 50) * 60, i, ok))
    df = spark.createDataFrame(rows, "target int, sec bigint, event_id int, ok boolean").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r["event_id"]: r["state"] for r in traffic.health_states(df, up, down, slices).collect()}
    want = {}
    for target in range(6):
        want.update(states([(s, e, o) for t, s, e, o in rows if t == target], up, down))
    assert got == want


def test_probes_without_target_or_time_keep_a_row(spark):
    df = spark.createDataFrame([(None, 1, 1, True), (1, None, 2, True), (1, 3, 3, True), (1, 4, 4, True)], "target int, sec bigint, event_id int, ok boolean")
    got = traffic.health_states(df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")).collect()
    assert {r["event_id"]: r["state"] for r in got} == {1: None, 2: None, 3: "unknown", 4: "healthy"}


def test_lifecycle_and_rotation(spark):
    objects = spark.createDataFrame(
        [(1, "documents", "2024-01-01"), (2, "documents", "2024-03-01"), (3, "documents", "2024-03-31"), (4, "logs", "2024-03-02"), (5, "other", "2020-01-01"), (6, "logs", "2024-05-01"), (7, "logs", None)],
        "id int, class string, day string",
    ).withColumn("created", F.to_date("day"))
    got = {r["id"]: r["stage"] for r in traffic.lifecycle(objects, rules.lifecycle(spark), "2024-04-01").collect()}
    assert got == {1: "archive", 2: "infrequent_access", 3: "standard", 4: "expired", 5: "standard", 6: "not_yet", 7: None}
    rotated = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-03-02"), ("b", "2024-03-01"), ("b", "2024-05-01"), ("c", "2024-05-01"), ("d", None)], "name string, day string").withColumn("rotated_at", F.to_date("day"))
    got = sorted(tuple(r) for r in traffic.rotation_due(rotated, ["name"], "2024-04-01").collect())
    assert got == [("a", 30, "current"), ("b", 31, "due"), ("c", None, "not_yet"), ("d", None, "unknown")]


def test_lifecycle_with_many_thresholds(spark):
    table = spark.range(0, 2000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("class"), F.col("id").cast("int").alias("days"), F.concat(F.lit("s"), "id").alias("stage")
    )
    objects = spark.range(1, 400).select(
        "id", F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("class"), F.expr("date_sub(date'2024-04-01', cast(id AS int) * 7)").alias("created")
    )
    got = {r["id"]: r["stage"] for r in traffic.lifecycle(objects, table, "2024-04-01").collect()}
    top = lambda i: max(d for d in range(2000) if d % 2 == (i % 3 == 0) and d <= i * 7)
    assert got == {i: f"s{top(i)}" for i in range(1, 400)}


def test_dead_letters(spark):
    rows = [("processing", "m", i) for i in range(4)] + [("processing", "n", i) for i in range(3)] + [("urgent", "m", i) for i in range(5)]
    df = spark.createDataFrame(rows, "queue string, message_id string, sec int").withColumn("ts", F.timestamp_seconds("sec"))
    got = traffic.dead_letters(df, rules.queue_limits(spark), "1970-01-15").collect()
    assert [(r["queue"], r["message_id"], r["receives"], str(r["expires_on"]), r["expired"]) for r in got] == [("processing", "m", 4, "1970-01-15", True)]


def test_rounds_on_their_own_results_keep_a_size_that_planning_can_handle(spark):
    rows = spark.range(100).selectExpr("id AS node", "id + 1 AS to", "CAST(1 AS INT) AS dist")
    ends, circling = topology._collapsed_chains(rows)
    assert {(r.node, r.to, r.dist) for r in ends.collect()} == {(n, 100, 100 - n) for n in range(100)}
    assert circling.isEmpty()
    assert int(str(ends._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000


def test_nodes_on_which_many_hang_are_told_to_all(spark, monkeypatch):
    monkeypatch.setattr(topology, "HOT", 5)
    deps = [(n, n // 2) for n in range(2, 120)] + [(n, 1) for n in range(120, 200)] + [(3, 7), (200, 50), (200, 49), (201, 200), (201, 1)]
    nodes = spark.createDataFrame([(n, n) for n in range(1, 202)], "node long, declared_order int")
    found = topology.deploy_levels(nodes, spark.createDataFrame(deps, "node long, depends_on long"), 10)
    below = {n: [d for m, d in deps if m == n] for n in range(1, 202)}
    circle = {3, 7}
    behind = set()
    for n in sorted(below):
        if n not in circle and any(d in circle | behind for d in below[n]):
            behind.add(n)
    level = {}
    for n in sorted(set(below) - circle - behind):
        level[n] = max((level[d] + 1 for d in below[n]), default=0)
    rows = found.collect()
    assert {r.node: r.level for r in rows} == {n: level.get(n) for n in below}
    assert {r.node for r in rows if r.in_cycle} == circle and {r.node for r in rows if r.behind_cycle} == behind
