"""Walks in which assets are not listed, against walks along all listed edges."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cipherledger import session
from cipherledger.operators import graph
from cipherledger.plans import registry
from cipherledger.sources.estate import Estate

SF = "/root/testdata/sf0.001"
ASSET = ("gkey", "asset_id", "owner", "application", "repository", "file", "container", "algorithm", "library", "library_version",
         "protocol", "protocol_version", "certificate_serial", "certificate_subject", "certificate_issuer")
ASSETS = [
    ("1", "ca-1", "o1", "a1", "r1", "r1/x", None, "aes", "ssl", "1", None, None, None, None, None),
    ("2", "ca-2", "o1", "a1", "r1", "r1/x", "c1", "rsa", "ssl", None, "TLS", "1.2", None, None, None),
    ("3", "ca-2", "o1", "a1", "r1", "r1/x", "c2", "aes", None, None, "TLS", None, None, None, None),      # an id twice
    ("4", "ca-4", "o2", "a2", None, "", "c2", "dsa", None, None, None, None, "s4", "CN=4", "CN=5"),       # declared by its application
    ("5", "ca-5", "o2", "a2", None, "s5.crt", None, "rsa", None, None, None, None, "s5", "CN=5", "CN=6"),
    ("6", "ca-6", None, None, None, "s6.crt", None, "ec", None, None, None, None, "s6", "CN=6", "CN=6"),  # unmapped
    ("7", "ca-7", None, "a9", "r9", "r9/y", "c1", "ec", "bc", "9", None, None, None, None, None),         # unknown application
    ("8", "ca-8", "o1", "a3", "", "z", "", None, "", "", "SSH", "", None, None, None),                    # empty strings
]


@pytest.fixture(scope="module")
def odd(spark):
    a = spark.createDataFrame(ASSETS, ", ".join(f"{n} string" for n in ASSET)).withColumn("asset_seq", F.struct("gkey"))
    a = a.withColumns({n: F.lit("x") for n in ("language", "asset_name", "cryptographic_role", "asset_type", "confidence", "algorithm_label")})
    apps = spark.createDataFrame([("a1", "A1", "o1", "u1", "f1"), ("a2", "A2", "o2", "u1", ""), ("a3", "A3", "o1", "u2", "f1"), ("a4", "A4", "unassigned", "u2", "f2")],
                                 "app_id string, name string, owner string, business_unit string, business_function string")
    apps = apps.withColumns({"data_classification": F.lit("d"), "data_lifetime_years": F.lit(3), "context_source": F.lit("s")})
    of = lambda name, rows: spark.createDataFrame(rows, f"app_id string, {name} string, ord long")
    bound = spark.createDataFrame([], "basename string, app_id string")
    return a, Estate(apps, of("repository", [("a1", "r1", 1), ("a4", "r4", 2)]), of("service", [("a1", "v1", 1), ("a3", "v1", 2), ("a8", "v8", 3)]).drop("ord"),
                     of("container", [("a2", "c1", 1), ("a4", "c4", 2)]), bound, bound)


@pytest.mark.parametrize("kind,depth", [("owner", 4), ("application", 5)])
def test_reach_counts(odd, kind, depth):
    a, estate = odd
    seeds = graph.nodes(a, estate).where(F.col("type") == kind).select("id").localCheckpoint()
    want = graph.reachable(graph.edges(a, estate).localCheckpoint(), seeds, depth, "out").groupBy("seed", "hops").count()
    got = graph.reach_counts([a], estate, kind, depth)
    assert got.columns == ["seed", "hops", "n"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("asset,depth", [("ca-1", 1), ("ca-2", 2), ("ca-5", 4)])
def test_neighbourhood_edges(odd, asset, depth):
    a, estate = odd
    nodes, edges = graph.nodes(a, estate).localCheckpoint(), graph.edges(a, estate).localCheckpoint()
    want = graph.neighbourhood(nodes, edges, asset, depth)[1]
    got = graph.asset_neighbourhood(graph.asset_lines([a]), estate, asset, depth)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("src", "dst", "type").collect()))


@pytest.mark.parametrize("name", ["owner_reach", "asset_neighbourhood"])
def test_walks_store_no_list_of_all_nodes_or_edges(spark, name):
    kept, before = dict(registry._SCANS), set(session._STAGES)
    registry._SCANS.clear()
    entry.queries()[name](spark, SF)
    stored = {os.path.basename(p)[6:-33] for p in set(session._STAGES) - before}
    registry._SCANS.clear()
    registry._SCANS.update(kept)
    assert not stored & {"nodes", "edges"}


def test_sets_of_a_certificate_are_joined_where_it_lies(spark):
    s = registry.scan(spark, SF)
    many = lambda *names: spark.range(10**8).selectExpr(*[f"cast(id AS string) AS {n}" for n in names], "id AS group_size", "id AS set_apps", "id AS set_services", "id AS set_units")
    certs = s.asset_parts[-1]
    part = graph.resource_columns(certs).withColumn("set_key", graph.set_key())
    plan = graph.attach_sets(part, many("set_key", "certificate_node"), many("set_key", "certificate_node").limit(3))._jdf.queryExecution().executedPlan().toString()
    before = part._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(by_dealt" not in plan and plan.count("Exchange hashpartitioning") == before.count("Exchange hashpartitioning") + 1
