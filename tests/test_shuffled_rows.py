"""Wide rows cross the network as rarely as their keys allow."""

from pyspark.sql import functions as F

from cipherledger.operators import graph, normalize
from cipherledger.plans import registry
from cipherledger.sources import driver_tables as dt

SF = "/root/testdata/sf0.001"


def test_facts_of_one_file_are_merged_where_they_lie(spark):
    s = registry.scan(spark, SF)
    inside, others = normalize.attributed(s.detections, s.estate)
    assert inside.where("certificate IS NOT NULL OR file IS NULL").count() == 0
    assert inside.count() + others.count() == s.detections.count()
    merged = normalize.merge(normalize.keyed(inside, local=True), "file")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "by_file" not in merged.columns and "hashpartitioning(gkey" not in plan
    again = normalize.merge(normalize.keyed(inside, local=True))
    assert merged.exceptAll(again.select(merged.columns)).count() == 0 == again.count() - merged.count()


def test_late_binding_by_the_file_of_the_strongest_evidence(spark):
    estate = dt.estate(spark, SF)
    rows = [("bin/x.bin", None), ("bin/x.bin", "c"), ("a/y.crt", None), ("repo-1/src/z.py", None), (None, "c")]
    d = spark.createDataFrame(rows, "file string, container string")
    bound = spark.createDataFrame([("x.bin", "app-1"), ("x.bin", "app-3"), ("z.py", "app-9")], "basename string, app_id string")
    certs = spark.createDataFrame([("y.crt", "app-2")], "basename string, app_id string")
    boxes = spark.createDataFrame([("app-5", "c", 1)], "app_id string, container string, ord long")
    found = normalize.late_places(normalize.places(d, estate.repositories, boxes), certs, bound)
    got = {(r.a_file, r.a_container): (r.application, r.late_app) for r in found.collect() if r.a_file}
    assert got[("bin/x.bin", None)] == (None, "app-3") and got[("bin/x.bin", "c")] == ("app-5", None)
    assert got[("a/y.crt", None)] == (None, "app-2") and got[("repo-1/src/z.py", None)][1] is None


def test_small_tables_of_centrality_are_read_at_their_size(spark):
    s = registry.scan(spark, SF)
    assert graph.with_centrality(s.assets, s.estate).where(F.col("sibling_assets").isNull()).count() == 0
