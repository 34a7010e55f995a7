"""Names as expressions over a resolved context (``operators.names.resolve_context``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import join_parts
from fleetlens.settings import Settings


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def application_name(type_code, specific, env="env_prefix", app="app_code", region="region_code") -> Column:
    env, app, region = _c(env), _c(app), _c(region)
    return join_parts(env, app, _c(type_code), region, _c(specific), required=(env, app, region))


def shared_name(type_code, specific, env="env_prefix", region="region_code") -> Column:
    env, region = _c(env), _c(region)
    return join_parts(env, F.lit("shared"), _c(type_code), region, _c(specific), required=(env, region))


def security_group_name(protected, purpose, env="env_prefix", app="app_code", region="region_code") -> Column:
    env, app, region = _c(env), _c(app), _c(region)
    return join_parts(env, app, F.lit("sg"), _c(protected), _c(purpose), region, required=(env, app, region))


def bucket_name(settings: Settings, purpose, env="env_prefix", app="app_code", region="region_code") -> Column:
    env, app, region = _c(env), _c(app), _c(region)
    return join_parts(F.lit(settings.domain), env, app, _c(purpose), region, required=(env, app, region))


def log_group_name(service, specific, env="env_prefix", app="app_code") -> Column:
    """Null as soon as the environment or the application is unknown; no region."""
    return F.concat(
        F.lit("/aws/"), F.lower(_c(service)), F.lit("/"), _c(env), F.lit("-"), _c(app),
        F.lit("-"), F.lower(_c(specific)),
    )


def shared_log_group_name(service, specific, env="env_prefix") -> Column:
    return log_group_name(service, specific, env, F.lit("shared"))


def image_repository_name(settings: Settings, repository_type, app="app_name") -> Column:
    """The repository type keeps its case."""
    return F.concat(F.lit(f"{settings.organisation}/"), F.lower(_c(app)), F.lit("/"), _c(repository_type))


def arn(service, kind, name, account="account_id", region="region") -> Column:
    """``kind`` is role, policy or user for iam; buckets carry neither region nor account."""
    service, kind, name = _c(service), _c(kind), _c(name)
    account, region = _c(account), _c(region)
    return (
        F.when(service == "iam", F.concat(F.lit("arn:aws:iam::"), account, F.lit(":"), kind, F.lit("/"), name))
        .when(service == "s3", F.concat(F.lit("arn:aws:s3:::"), name))
        .when(
            service.isin("sqs", "sns"),
            F.concat(F.lit("arn:aws:"), service, F.lit(":"), region, F.lit(":"), account, F.lit(":"), name),
        )
    )


def stack_name(stack, env="env_prefix", app="app_code", region="region_code") -> Column:
    """``app`` and ``base`` are the whole-application and shared stacks; others go by their type."""
    stack, env, app, region = _c(stack), _c(env), _c(app), _c(region)
    typed = lambda middle, kind: F.concat_ws("-", env, middle, kind, region)
    return F.when(
        env.isNotNull() & app.isNotNull() & region.isNotNull(),
        F.when(stack == "app", typed(app, F.lit("stack")))
        .when(stack == "base", typed(F.lit("shared"), F.lit("stack")))
        .when(F.lower(stack).isin("alb", "ecs", "data", "cognito"), typed(app, F.lower(stack))),
    )


def export_name(suffix, env="env_name", app: str | Column | None = "app_name") -> Column:
    """Full environment and application names, case kept; ``app=None`` for shared exports."""
    parts = [_c(env)] + ([] if app is None else [_c(app)]) + [_c(suffix)]
    return F.concat(*[x for p in parts for x in (F.lit("-"), p)][1:])


def secret_path(secret, env="env_name", app="app_name") -> Column:
    return F.concat(F.lit("/"), F.lower(_c(env)), F.lit("/"), F.lower(_c(app)), F.lit("/"), _c(secret))


def stack_role_name(kind: str, env="env_name", app="app_name") -> Column:
    return F.concat(_c(env), F.lit("-"), F.lower(_c(app)), F.lit(f"-{kind}-role"))


def auth_domain_prefix(env="env_name", app="app_name") -> Column:
    return F.concat(F.lower(_c(env)), F.lit("-"), F.lower(_c(app)), F.lit("-auth"))


def name_layout(settings: Settings, template="template", type_code="type_code") -> dict[str, Column]:
    """What a template puts where, as columns of the rule table.

    Worked out once per rule row, so that a resource's name is one short expression.
    """
    template, code = _c(template), _c(type_code)
    log = template.isin("app_log", "shared_log")
    return {
        "_head": F.when(template == "bucket", F.lit(settings.domain)),
        "_owner": F.when(template.isin("shared", "shared_log"), F.lit("shared")),
        "_first": F.when(template == "security_group", F.lit("sg")),
        "_code": F.when(template.isin("app", "shared", "security_group"), code),
        "_typed": template.isin("app", "shared", "security_group"),
        "_region_inside": template.isin("app", "shared"),
        "_log": log,
        "_image": template == "image",
    }


def name_from_layout(settings: Settings, specific: Column, service: Column, type_code: Column | None = None) -> Column:
    """The name of a resolved row joined with :func:`name_layout`.

    ``type_code`` stands in where the rule has none (custom kinds).
    """
    c = F.col
    code = c("_code") if type_code is None else F.coalesce("_code", F.when(c("_typed"), type_code))
    owner = F.coalesce("_owner", "app_code")
    dashed = F.lower(
        F.concat_ws(
            "-",
            c("_head"),
            c("env_prefix"),
            owner,
            c("_first"),
            F.nullif(code, F.lit("")),
            F.when(c("_region_inside"), c("region_code")),
            F.nullif(specific, F.lit("")),
            F.when(~c("_region_inside"), c("region_code")),
        )
    )
    log = F.concat(F.lit("/aws/"), F.lower(service), F.lit("/"), c("env_prefix"), F.lit("-"), owner, F.lit("-"), F.lower(specific))
    known = c("env_prefix").isNotNull() & owner.isNotNull() & c("region_code").isNotNull()
    return (
        F.when(c("_log"), log)
        .when(c("_image"), image_repository_name(settings, specific))
        .when(known & c("_log").isNotNull(), dashed)
    )

