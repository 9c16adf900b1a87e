"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage


def _stars(both: DataFrame) -> DataFrame:
    """Each node of a symmetric (u, v) table with its least neighbour, itself included."""
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a (a, b) table of long ids links; the component
    is its smallest node. Rows with a null end and self-links are ignored; an empty table
    gives no rows.

    Large-star and small-star steps alternate until the table repeats: every step moves
    links to smaller nodes and keeps the components, so it ends with one star each. Steps
    read and write stage tables, which survive lost executors. Minima are aggregated before
    they are shuffled, and written before they are joined back: both sides of that join are
    then plain exchanges, which adaptive execution splits where a node has most of the links.
    """
    state = write_stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _signature(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = write_stage(_stars(both), "nearest")
        large = write_stage(both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = write_stage(_stars(large), "least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = write_stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop_stage(state, large, nearest, least)
        state, before = small, seen
        seen = _signature(state)
        if seen == before:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _signature(state: DataFrame) -> tuple:
    """Number of links and an order-free digest of them: one row. The bits of two hashes are
    combined by exclusive or, which no number of links overflows; links are distinct."""
    return tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
