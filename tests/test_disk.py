"""What a query keeps on disk: narrow tables only, and nothing of jobs that have ended."""

import os

import pytest

import __spark_entry__ as entry
from cipherledger import session
from cipherledger.operators import normalize
from cipherledger.plans import registry

SF = "/root/testdata/sf0.001"
NARROW = {"places", "applications", "links", "shared", "joint-sets", "joint-members", "coupling", "coupling-joint", "own-services", "algorithm-users", "peak"}


@pytest.fixture
def fresh(spark):
    """A scan that has kept nothing yet; others get theirs back."""
    kept, before = dict(registry._SCANS), set(session._STAGES)
    registry._SCANS.clear()
    yield lambda: {os.path.basename(p)[6:-33] for p in set(session._STAGES) - before}
    registry._SCANS.clear()
    registry._SCANS.update(kept)


@pytest.mark.parametrize("name", [
    "classical_axis", "quantum_axis", "risk_factor_table", "migration_decisions", "decision_summary",
    "asset_provenance", "headlines", "criticality_crosstab", "bom_components"])
def test_row_wise_queries_store_no_assets(spark, fresh, name):
    entry.queries()[name](spark, SF)
    assert fresh() <= {"places", "applications"}


def test_coupled_properties_store_narrow_tables_only(spark, fresh):
    entry.queries()["bom_properties_all"](spark, SF)
    assert fresh() <= NARROW


@pytest.mark.parametrize("name,stages", [
    ("graph_counts", {"certificates"}), ("bom_dependencies", {"referred"}), ("override_audit", {"held"}), ("inventory_served_page", {"inventory"})])
def test_queries_store_only_what_they_read(spark, fresh, name, stages):
    entry.queries()[name](spark, SF)
    assert fresh() <= {"places", "applications"} | stages


def test_rows_are_dealt_before_they_widen(spark):
    from cipherledger.sources import driver_tables as dt
    merged = normalize.merge(normalize.keyed(dt.derived(spark, SF).local.selectExpr(
        "*", "'r' AS repository", "'a' AS application", "'b' AS late_app"), local=True), "file")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ENSURE_REQUIREMENTS" not in plan


def test_shuffle_files_go_with_their_job(spark, fresh):
    registry.scan(spark, SF)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
