"""Policy statements, request evaluation, isolation rules and trust subjects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions.text import matches, wildcard

ANY_AUDIENCE = "*"
LIKES = "array<struct<first:string,last:string,middle:array<string>,star:boolean,regex:string>>"
CONDITIONS = f"array<struct<op:string,key:string,patterns:array<struct<text:string,like:{LIKES[6:-1]}>>>>"
CONDITION_OPERATORS = ["StringEquals", "StringLike", "ForAnyValue:StringLike"]


def flatten_statements(statements: DataFrame) -> DataFrame:
    """One row per statement, action and resource; a statement without either keeps a row with null.

    ``not_actions`` and ``not_resources`` stay lists, as all their entries must be spared at
    once: such a statement is about action or resource ``*`` except those.
    """
    given = {c: F.col(c) for c in ("actions", "resources")}
    for c in given:
        if f"not_{c}" in statements.columns:
            given[c] = F.coalesce(given[c], F.when(F.col(f"not_{c}").isNotNull(), F.array(F.lit("*"))))
    kept = [c for c in statements.columns if c not in given]
    return (
        statements.select(*kept, given["resources"].alias("resources"), F.explode_outer(given["actions"]).alias("action"))
        .select(*kept, "action", F.explode_outer("resources").alias("resource"))
    )


def policy_checks(
    statements: DataFrame, keys: list[str], action_texts: list[str], resource_text: str, strict_arrays: bool = False
) -> DataFrame:
    """Per policy: does any action contain each text, any resource the path, any statement deny?

    ``strict_arrays`` only looks at actions and resources written as arrays.
    """

    def any_contains(column: str, is_array: str, text: str) -> Column:
        found = F.exists(column, lambda v: F.contains(v, F.lit(text)))
        if strict_arrays:
            found = found & F.col(is_array)
        return F.coalesce(F.bool_or(found), F.lit(False))

    checks = [
        any_contains("actions", "action_is_array", text).alias(f"has_action_{i}")
        for i, text in enumerate(action_texts)
    ]
    return statements.groupBy(*keys).agg(
        *checks,
        any_contains("resources", "resource_is_array", resource_text).alias("has_path"),
        F.coalesce(F.bool_or(F.col("effect") == "Deny"), F.lit(False)).alias("has_deny"),
    )


def prepare_statements(flat: DataFrame) -> DataFrame:
    """Cut the patterns of flattened statements at their wildcards."""

    def likes(column: str, ignore_case: bool = False) -> Column:
        if column not in flat.columns:
            return F.expr(f"cast(array() AS {LIKES})")
        return F.coalesce(F.transform(column, lambda p: wildcard(p, ignore_case)), F.expr(f"cast(array() AS {LIKES})"))

    conditions = F.coalesce(
        F.transform(
            "conditions",
            lambda c: F.struct(
                c["op"].alias("op"),
                c["key"].alias("key"),
                F.transform(c["patterns"], lambda p: F.struct(p.alias("text"), wildcard(p).alias("like"))).alias("patterns"),
            ),
        ),
        F.array(),
    ) if "conditions" in flat.columns else F.expr(f"cast(array() AS {CONDITIONS})")
    return flat.withColumns(
        {
            "action_like": wildcard(F.col("action"), ignore_case=True),
            "resource_like": wildcard(F.col("resource")),
            "spared_actions": likes("not_actions", ignore_case=True),
            "spared_resources": likes("not_resources"),
            "conditions": conditions,
        }
    )


def _known(c: Column) -> Column:
    return F.coalesce(c["op"].isin(CONDITION_OPERATORS), F.lit(False))


#: Truth values in order, so that the least of several is their conjunction.
FALSE, UNKNOWN, TRUE = 0, 1, 2


def _holds(c: Column, values: Column) -> Column:
    """One value and one pattern are enough; unknown if the operator or the values are."""

    def one(v: Column, p: Column) -> Column:
        return F.when(c["op"] == "StringEquals", v == p["text"]).otherwise(matches(v, p["like"]))

    hit = F.exists(values, lambda v: F.exists(c["patterns"], lambda p: F.coalesce(one(v, p), F.lit(False))))
    return F.when(~_known(c) | values.isNull(), UNKNOWN).when(hit, TRUE).otherwise(FALSE)


def _verdict(conditions: Column, values_of: Callable[[Column], Column]) -> Column:
    """Do all conditions hold? ``values_of`` gives the values of a key, null where they are not known."""
    return F.coalesce(F.array_min(F.transform(conditions, lambda c: _holds(c, values_of(c["key"])))), F.lit(TRUE))


# --- pattern index ------------------------------------------------------------------------

#: Lengths of literal beginnings that patterns are filed under; EXACT files the whole of a pattern without a wildcard.
LENGTHS = [*range(0, 64, 4), *range(64, 513, 32)]
EXACT = -1
#: Copies of each answer, and shares of the requests that meet them, so that a frequent question is spread.
SALTS = 8


def _filed(pattern: Column, exact: Column | None = None) -> Column:
    """(level, key): the longest literal beginning of a length in ``LENGTHS``, or the whole of an exact pattern."""
    literal = F.length(F.regexp_extract(pattern, r"^[^*?]*", 0))
    whole = (literal == F.length(pattern)) if exact is None else exact | (literal == F.length(pattern))
    level = F.when(whole, EXACT).otherwise(F.array_max(F.filter(F.array(*map(F.lit, LENGTHS)), lambda n: n <= literal)))
    return F.struct(level.alias("level"), F.when(level == EXACT, pattern).otherwise(F.substring(pattern, F.lit(1), level)).alias("key"))


def _looked_up(value: Column, level: Column) -> Column:
    """The key under which a matching pattern of that level is filed; null if the value is too short."""
    return F.when(level == EXACT, value).when(F.length(value) >= level, F.substring(value, F.lit(1), level))


def _meet(questions: DataFrame, values: dict[str, Column], filed: DataFrame, keys: list[str]) -> DataFrame:
    """Questions joined with the rows of ``filed`` whose patterns begin as their values do.

    ``filed`` has a column (level, key) for each of ``values``. Only the combinations of levels
    that occur are looked up; they are as many as the lengths allow at most. Each row of ``filed``
    has one key, so a question meets the few rows that share a beginning with it.
    """
    names = list(values)
    levels = filed.agg(F.collect_set(F.struct(*[F.col(f"{n}.level").alias(n) for n in names]))).scalar()
    asked = questions.withColumn("_level", F.explode(levels))
    for n in names:
        asked = asked.withColumns({f"_{n}_level": F.col(f"_level.{n}"), f"_{n}_key": _looked_up(values[n], F.col(f"_level.{n}"))})
    placed = filed.withColumns({f"_{n}_level": F.col(f"{n}.level") for n in names} | {f"_{n}_key": F.col(f"{n}.key") for n in names})
    on = [*keys, *[f"_{n}_{part}" for n in names for part in ("level", "key")]]
    return asked.drop("_level").join(placed.drop(*names), on)


def _decided(groups: GroupedData, verdict: str, extra: list[Column]) -> DataFrame:
    """Does a statement of each effect hold, or may it; null verdicts are statements that do not apply."""
    deny, allow = F.col("effect") == "Deny", F.col("effect") == "Allow"
    value = F.col(verdict)
    cases = {
        "deny": deny & (value == TRUE), "open": deny & (value == UNKNOWN), "allow": allow & (value == TRUE), "maybe": allow & (value == UNKNOWN),
    }
    return groups.agg(
        *[F.coalesce(F.bool_or(test), F.lit(False)).alias(f"_{name}") for name, test in cases.items()],
        *[F.min(F.when(test, F.col("sid"))).alias(f"_{name}_sid") for name, test in cases.items()],
        *extra,
    )


def unsupported_conditions(statements: DataFrame) -> DataFrame:
    """Conditions whose operator is none of the three."""
    kept = [c for c in statements.columns if c != "conditions"]
    return statements.select(*kept, F.explode_outer("conditions").alias("_c")).select(
        *kept, F.col("_c.op").alias("op"), F.col("_c.key").alias("key")
    ).filter(~F.col("op").isin(CONDITION_OPERATORS))


def evaluate(requests: DataFrame, statements: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Add ``decision`` and ``matched_sid`` to requests (keys, action, resource[, context]).

    ``keys`` tie a request to its policies, e.g. the principal. ``statements`` come from
    ``flatten_statements``. An explicit deny beats a deny that cannot be judged, as its
    condition operator is not supported (``undetermined``); that beats an allow, which beats
    the implicit deny. An allow that cannot be judged does not allow. A condition on a key that
    the request does not carry does not hold.

    Requests are first reduced to what they ask, as few things are asked often. These meet the
    statements of their keys that are filed under a beginning of their action and resource,
    however many statements one key has, and the decision goes back to every request that
    asked, whatever ids it has or lacks; frequent questions are spread over ``salts`` tasks.
    """
    given = {c: F.col(c) for c in [*keys, "action", "resource"]}
    if "context" in requests.columns:
        given["context"] = F.array_sort(F.map_entries("context"))
    told = requests.withColumns({f"_asked_{c}": v for c, v in given.items()} | {"_salt": F.pmod(F.monotonically_increasing_id(), F.lit(salts))})
    asked = [f"_asked_{c}" for c in given]
    fields = ["action_like", "resource_like", "spared_actions", "spared_resources", "conditions"]
    filed = prepare_statements(statements).select(
        *[F.col(k).alias(f"_asked_{k}") for k in keys], "effect", "sid", *fields, "action", "resource"
    )
    # generated, as a join key that is computed would be computed once more by the filter on it
    for name, pattern in (("at_action", F.lower("action")), ("at_resource", F.col("resource"))):
        filed = filed.select("*", F.explode(F.array(_filed(pattern))).alias(name))
    filed = filed.drop("action", "resource")
    action, resource = F.col("_asked_action"), F.col("_asked_resource")
    met = _meet(
        told.select(*asked).distinct(), {"at_action": F.lower(action), "at_resource": resource}, filed, [f"_asked_{k}" for k in keys]
    )
    scope = (
        matches(action, F.col("action_like"), ignore_case=True)
        & matches(resource, F.col("resource_like"))
        & ~F.exists("spared_actions", lambda p: matches(action, p, ignore_case=True))
        & ~F.exists("spared_resources", lambda p: matches(resource, p))
    )
    none = F.array().cast("array<string>")

    def values_of(key: Column) -> Column:
        if "context" not in given:
            return none
        return F.coalesce(F.get(F.filter("_asked_context", lambda e: e["key"] == key), F.lit(0))["value"], none)

    judged = met.withColumn("_verdict", F.when(scope, _verdict(F.col("conditions"), values_of)))
    decided = _decided(judged.groupBy(*asked), "_verdict", [])
    order = [("_deny", "explicit_deny"), ("_open", "undetermined"), ("_allow", "allow")]
    answer = F.coalesce(
        *[F.when(F.col(flag), F.struct(F.lit(said).alias("decision"), F.col(f"{flag}_sid").alias("sid"))) for flag, said in order]
    )
    answers = decided.select(
        *[F.col(c).alias(f"_of{c}") for c in asked], answer.alias("_answer"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_share")
    )
    same = F.col("_salt") == F.col("_share")
    for c in asked:
        same = same & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    return told.join(answers, same, "left").select(
        *requests.columns, F.coalesce("_answer.decision", F.lit("implicit_deny")).alias("decision"), F.col("_answer.sid").alias("matched_sid")
    )


def isolation_rules(contexts: DataFrame) -> DataFrame:
    """Statements that keep each context to its own and the shared secrets of its environment.

    The denied environments are a set difference within the row; contexts are not paired.
    """
    env, app = F.lower("env_name"), F.lower("app_name")
    base = F.concat(
        F.lit("arn:aws:secretsmanager:"), F.col("region"), F.lit(":"), F.col("account_id"), F.lit(":secret:/"), env
    )
    read = F.array(F.lit("secretsmanager:GetSecretValue"), F.lit("secretsmanager:DescribeSecret"))
    every = F.array(F.lit("*"))
    names = F.array(*[F.lit(e[0].lower()) for e in rules.ENVIRONMENTS])
    others = F.transform(F.array_except(names, F.array(env)), lambda e: F.concat(F.lit("/"), e, F.lit("/*")))
    condition = lambda op, key, patterns: F.array(
        F.struct(F.lit(op).alias("op"), F.lit(key).alias("key"), patterns.alias("patterns"))
    )
    none = F.filter(condition("", "", every), lambda c: F.lit(False))

    def statement(sid: str, effect: str, actions: Column, resources: Column, conditions: Column) -> Column:
        return F.struct(
            F.lit(sid).alias("sid"), F.lit(effect).alias("effect"), actions.alias("actions"),
            resources.alias("resources"), conditions.alias("conditions"),
        )

    statements = F.array(
        statement(
            "AllowSecretsManagerAccess", "Allow", read,
            F.array(F.concat(base, F.lit("/"), app, F.lit("/*")), F.concat(base, F.lit("/shared/*"))), none,
        ),
        statement(
            "AllowKMSDecrypt", "Allow",
            F.array(F.lit("kms:Decrypt"), F.lit("kms:DescribeKey"), F.lit("kms:GenerateDataKey")), every,
            condition(
                "StringEquals", "kms:ViaService",
                F.array(F.concat(F.lit("secretsmanager."), F.col("region"), F.lit(".amazonaws.com"))),
            ),
        ),
        statement(
            "DenyCrossEnvironmentSecrets", "Deny", read, every,
            condition("ForAnyValue:StringLike", "secretsmanager:SecretId", others),
        ),
    )
    return contexts.select(*contexts.columns, F.inline(statements))


WEB_IDENTITY = "sts:AssumeRoleWithWebIdentity"
#: Shares of the subjects that are told for the roles of a class apart.
SHARES = 64
_NO_CONDITIONS = "cast(array() AS array<struct<op:string,key:string,patterns:array<string>>>)"


def trust_decisions(
    subjects: DataFrame, statements: DataFrame, role: str, action: str = WEB_IDENTITY, shown: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """(audience, subject, role, decision, patterns) wherever a role's documents may let a subject in.

    ``statements`` come from the policy documents, with the role's name in ``role``. Conditions
    on keys that end in ``:aud`` and ``:sub`` are judged; one on another key, or with an operator
    that is not supported, is unknown. All conditions of a statement must hold: it is false if
    one is false, else unknown if one is. Over the statements of a role a deny that holds beats
    one that is unknown (``undetermined``), which beats an allow that holds; an allow that is
    only unknown is ``undetermined`` too and never lets anybody in. Roles that certainly allow
    nothing to a subject give no row. ``patterns`` are the subject patterns that held in the
    statements behind the decision, in order; ``shown`` makes of them what the rows hold, once
    for a class and not for each of its roles.

    Roles whose statements are the same decide alike: subjects meet one class of them, and only
    what a class decides is told for each of its roles, spread over ``SHARES`` of the subjects.
    Statements are filed under beginnings of an audience and a subject pattern of theirs, so a
    subject meets those it may satisfy; one without such a condition meets every subject.
    """
    this = F.lit(action)
    named = F.exists("actions", lambda a: matches(this, wildcard(a, ignore_case=True), ignore_case=True))
    spared = F.exists("not_actions", lambda a: matches(this, wildcard(a, ignore_case=True), ignore_case=True))
    about = F.coalesce(named, F.lit(False)) | (F.col("not_actions").isNotNull() & ~F.coalesce(spared, F.lit(False)))
    kept = F.when(about & F.col("principal").isNotNull() & F.col("effect").isin("Allow", "Deny"), F.array(F.lit(1)))
    given = F.coalesce("conditions", F.expr(_NO_CONDITIONS))

    def filed_under(suffix: str) -> Column:
        """The patterns of the first condition on the key that can be judged; all must hold, so one is enough to find it."""
        judged = F.filter(F.col("_given"), lambda c: F.endswith(c["key"], F.lit(suffix)) & _known(c))
        patterns = F.get(F.transform(judged, lambda c: F.transform(c["patterns"], lambda p: _filed(p, c["op"] == "StringEquals"))), F.lit(0))
        return F.coalesce(patterns, F.array(_filed(F.lit("*"))))

    per_role = (
        statements.select(F.col(role).alias("role"), "effect", given.alias("_given"), F.explode(kept).alias("_one"))
        .groupBy("role").agg(F.array_sort(F.collect_set(F.struct("effect", "_given"))).alias("_statements"))
    )
    # generated, so that the join on it does not compute it twice; both uses share the shuffle by role
    per_role = per_role.select("*", F.explode(F.array(F.sha2(F.to_json("_statements"), 256))).alias("class"))
    filed = (
        per_role.groupBy("class").agg(F.first("_statements").alias("_statements"))
        .select("class", F.inline("_statements"))
        .select("class", "effect", F.lit(None).cast("string").alias("sid"), "_given", F.explode(filed_under(":aud")).alias("at_audience"))
        .select("*", F.explode(filed_under(":sub")).alias("at_subject"))
    )
    conditions = F.transform(
        "_given",
        lambda c: F.struct(
            c["op"].alias("op"), c["key"].alias("key"),
            F.transform(c["patterns"], lambda p: F.struct(p.alias("text"), wildcard(p).alias("like"))).alias("patterns"),
        ),
    )
    filed = filed.withColumn("conditions", conditions).drop("_given")
    asked = subjects.select("audience", "subject").distinct()
    met = _meet(asked, {"at_audience": F.col("audience"), "at_subject": F.col("subject")}, filed, [])

    def values_of(key: Column) -> Column:
        return F.when(F.endswith(key, F.lit(":aud")), F.array("audience")).when(F.endswith(key, F.lit(":sub")), F.array("subject"))

    def held(c: Column) -> Column:
        subject = F.col("subject")
        hit = lambda p: F.when(c["op"] == "StringEquals", subject == p["text"]).otherwise(matches(subject, p["like"]))
        return F.transform(F.filter(c["patterns"], hit), lambda p: p["text"])

    told = F.flatten(F.transform(F.filter("conditions", lambda c: F.endswith(c["key"], F.lit(":sub")) & _known(c)), held))
    judged = met.withColumns({"_verdict": _verdict(F.col("conditions"), values_of), "_told": told})
    # a pattern list is as long as the documents of one role make it
    gathered = [
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when((F.col("effect") == effect) & (F.col("_verdict") == value), F.col("_told")))))).alias(name)
        for name, effect, value in (("_p_deny", "Deny", TRUE), ("_p_open", "Deny", UNKNOWN), ("_p_allow", "Allow", TRUE), ("_p_maybe", "Allow", UNKNOWN))
    ]
    decided = _decided(judged.groupBy("audience", "subject", "class"), "_verdict", gathered)
    some = F.when(F.col("_allow") | F.col("_maybe"), F.array(F.lit(1)))
    order = [("_deny", "explicit_deny"), ("_open", "undetermined"), ("_allow", "allow"), ("_maybe", "undetermined")]
    decision = F.coalesce(*[F.when(F.col(flag), F.lit(said)) for flag, said in order])
    patterns = F.coalesce(*[F.when(F.col(flag), F.col(f"_p{flag}")) for flag, _ in order])
    told = decided.select("audience", "subject", "class", decision.alias("decision"), shown(patterns).alias("patterns"), F.explode(some).alias("_one")).drop("_one")
    # in a fixed number of parts, as few small rows on either side make many
    parts = max(SHARES, int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of_class = told.withColumn("_share", F.pmod(F.xxhash64("audience", "subject"), F.lit(SHARES))).repartition(parts, "class", "_share")
    members = per_role.select("class", "role", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<bigint>")).alias("_share")).repartition(parts, "class", "_share")
    return of_class.join(members, ["class", "_share"]).select("audience", "subject", "role", "decision", "patterns")


def trust_matches(subjects: DataFrame, trust: DataFrame) -> DataFrame:
    """Which role each (audience, subject) may assume, and by which pattern.

    Audiences must be equal, which makes it an equi-join; the subject pattern is tested on
    the joined row, so only matches leave the join. A null audience in ``trust`` allows any;
    ``exact`` in ``trust`` takes the pattern by the letter.
    """
    prepared = trust.withColumns({"_like": wildcard(F.col("pattern")), "_audience": F.coalesce("audience", F.lit(ANY_AUDIENCE))})
    letter = F.col("exact") if "exact" in trust.columns else F.lit(False)
    hit = F.when(letter, F.col("subject") == F.col("pattern")).otherwise(matches(F.col("subject"), F.col("_like")))
    asked = subjects.withColumn("_audience", F.explode(F.array("audience", F.lit(ANY_AUDIENCE))))
    return (
        asked.join(prepared.drop("audience"), "_audience")
        .filter(hit)
        .select(*subjects.columns, "role", "pattern")
    )
