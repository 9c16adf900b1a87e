"""A spread of registered queries against their SQL at the smallest scale.

``python tests/compare.py`` runs all of them.
"""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["merged_assets", "classical_axis", "risk_scores", "migration_decisions", "dependency_centrality",
         "remediation_transitions", "config_cipher_suites", "redacted_documents"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(con, spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
