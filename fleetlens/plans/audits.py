"""Audits composed of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import containers, names, requirements
from fleetlens.settings import Settings


def name_summary(inventory: DataFrame, settings: Settings) -> DataFrame:
    """Valid, invalid and context-less names per environment and kind.

    Context, expected name and comparison run in the scan's stage; the only shuffle carries
    partial counts.
    """
    audited = names.audit_names(inventory, settings)
    return requirements.summarise(audited, ["env_name", "kind"]).select(
        "env_name", "kind", "total", "valid", "invalid", "no_context"
    )


def name_findings(inventory: DataFrame, settings: Settings, keep: list[str]) -> DataFrame:
    """Resources whose observed name is not the expected one.

    The finding is generated from the row instead of filtered: a filter would be pushed
    below the projection and build the expected name a second time.
    """
    audited = names.expected_names(inventory, settings)
    differs = F.lower("observed_name") != F.lower("expected_name")
    found = F.when(differs, F.array(F.struct("observed_name", "expected_name")))
    return audited.select(*keep, F.inline(found))


def service_findings(docs: DataFrame) -> DataFrame:
    """Violations and duplicate names of service documents (doc_id, doc) in one findings table."""
    violations = containers.container_violations(docs).select("doc_id", "rule", "message")
    duplicates = containers.duplicate_names(containers.explode_containers(docs), ["doc_id", "task_no", "task"])
    return violations.unionByName(
        duplicates.select(
            "doc_id",
            F.lit("duplicate_container").alias("rule"),
            F.concat(
                F.lit("Duplicate container names found in task '"), "task", F.lit("': "), "name"
            ).alias("message"),
        )
    )
