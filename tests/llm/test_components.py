"""The digest that ends the components' iteration."""

from pyspark.sql import functions as F

from cipherledger.llm.components import _signature


def test_signature_of_many_links(spark):
    n = 18_000_000
    links = spark.range(n).select(F.col("id").alias("u"), (-F.col("id")).alias("v"))
    first = _signature(links)
    assert first[0] == n and first == _signature(links.repartition(3))
    other = _signature(links.select("u", F.when(F.col("u") == 5, 1).otherwise(F.col("v")).alias("v")))
    assert other[0] == n and other[1] != first[1] and other[2] != first[2]
    assert _signature(links.limit(0))[0] == 0
