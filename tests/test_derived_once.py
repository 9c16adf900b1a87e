"""Assets are derived once for a query: what follows reads the narrow rows kept of them."""

import pytest

import __spark_entry__ as entry
from cipherledger import session
from cipherledger.operators import graph, impact, roadmap
from cipherledger.plans import registry, registry_reports, scan

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fresh(spark, monkeypatch):
    """A scan that has kept nothing yet, and the stages that read line items."""
    kept, stages = dict(registry._SCANS), []

    def watched(df, name, **options):
        stages.extend([name] if reads_lines(df) else [])
        return session.write_stage(df, name, **options)

    for module in (graph, impact, roadmap, scan, registry_reports):
        monkeypatch.setattr(module, "write_stage", watched)
    registry._SCANS.clear()
    yield stages
    registry._SCANS.clear()
    registry._SCANS.update(kept)


def reads_lines(df):
    return any("lineitem" in f for f in df.inputFiles())


@pytest.mark.parametrize("name,kept", [
    ("prerequisite_users", "judged"), ("critical_path_steps", "judged"), ("impact_effort", "judged"), ("report_sections", "judged"),
    ("graph_nodes", "node-lines"), ("graph_edges", "asset-lines")])
def test_assets_are_derived_once(spark, fresh, name, kept):
    out = entry.queries()[name](spark, SF)
    assert not reads_lines(out) and fresh == ["places", kept]
