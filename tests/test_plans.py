"""What the plans must look like to hold at scale."""

import re

import pytest

from fleetlens.plans import catalog
from fleetlens.sources import files

# these run jobs of their own while they are built
EAGER = {"n16_register_codes", "t3_deploy_levels", "s6_findings_sink", "r2_health_states", "s6_rerun_sink", "st1_drift_stream", "q10_range_drift", "s1_changed_files"}


# the derived rule table pairs every part with six languages that are written out
SIX_ROWS = "BroadcastNestedLoopJoin BuildRight, Cross"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - EAGER))
def test_no_pairwise_join_and_no_python_worker(spark, small, key):
    text = plan(catalog.QUERIES[key](spark, small))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Scan ExistingRDD", text.replace(SIX_ROWS, ""))


def test_plans_of_the_incremental_files(spark, tmp_path):
    """The query checkpoints its result, so its parts are looked at."""
    (tmp_path / "a.json").write_text("{}")
    listed = files.list_files(spark, str(tmp_path))
    changes = files.stage_changes(spark, str(tmp_path), str(tmp_path / "ledger"), 1)
    files.commit_changes(spark, str(tmp_path / "ledger"), 1)
    known = files.known_files(spark, str(tmp_path / "ledger"), 2)
    read = files.read_changed(changes, str(tmp_path))
    for df in (files.file_changes(listed, known), read):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Scan ExistingRDD", plan(df))
    assert "content" not in plan(listed)
    assert "GreaterThanOrEqual(modificationTime" in plan(read)  # the text is cut off after this one


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - EAGER))
def test_no_filter_repeats_the_work_of_a_projection(spark, small, key):
    """A computed column that is filtered on is pushed below its projection and computed twice."""
    text = catalog.QUERIES[key](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    longest = max([len(line) for line in text.splitlines() if re.match(r"[ :|+*\-]*Filter ", line)], default=0)
    assert longest < 1200


@pytest.mark.parametrize(
    "key, exchanges",
    [
        ("n2_application_name", 0), ("n11_name_audit", 0), ("fleet_name_summary", 1), ("k1_environment", 0), ("k16_batch_jobs", 0),
        ("k14_primary_container", 1), ("k17_health_checks", 0), ("k19_distinct_secrets", 1), ("p1_statements", 0), ("p5_isolation_rules", 0),
        ("q11_rule_differences", 1), ("st1_drift_windows", 1), ("s2_layered_merge", 1),
    ],
)
def test_number_of_shuffles(spark, small, key, exchanges):
    text = plan(catalog.QUERIES[key](spark, small))
    assert len(re.findall(r"Exchange (?:hash|range|Round|Single)", text)) == exchanges


@pytest.mark.parametrize("key", ["r3_lifecycle"])
def test_facts_are_not_shuffled(spark, small, key):
    """The only shuffles lie below a broadcast, that is, on the rules' side."""
    text = plan(catalog.QUERIES[key](spark, small))
    outside = []
    hidden = None
    for line in text.splitlines():
        depth = len(re.match(r"[ :|+*\-]*", line).group())
        if hidden is not None and depth > hidden:
            continue
        hidden = depth if "BroadcastExchange" in line else None
        outside.append(line)
    assert not [l for l in outside if re.search("Exchange hash", l)]


def test_only_needed_columns_are_read(spark, small):
    text = plan(catalog.QUERIES["fleet_name_summary"](spark, small))
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_extendedprice" not in schema and "l_tax" not in schema and "l_orderkey" in schema


def test_filters_reach_the_scan(spark, small):
    text = plan(catalog.QUERIES["st1_drift_windows"](spark, small))
    assert "EqualTo(event_type,error)" in text
