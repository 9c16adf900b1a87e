"""Operator-declared business context: applications, repositories and bindings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "estate_id string, name string, context_source string, applications array<struct<"
    "app_id:string, name:string, owner:string, business_unit:string, environment:string, "
    "criticality:string, exposure:string, data_classification:string, "
    "data_lifetime_years:int, description:string, business_function:string, "
    "repositories:array<string>, containers:array<string>, services:array<string>, "
    "regulatory:array<string>>>, certificate_bindings map<string,string>, "
    "binary_bindings map<string,string>")


@dataclass
class Estate:
    """Long tables instead of nested lists: an application may own millions of
    repositories."""

    applications: DataFrame          # app_id, name, owner, ..., regulatory
    repositories: DataFrame          # app_id, repository, ord
    services: DataFrame              # app_id, service
    containers: DataFrame            # app_id, container, ord
    certificate_bindings: DataFrame  # basename, app_id
    binary_bindings: DataFrame       # basename, app_id
    estate_id: str = "estate"


def read_estate(spark: SparkSession, path: str, repo_root: str = "") -> Estate:
    """Read a JSON manifest, fill the declared defaults and flatten its lists."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    source = F.coalesce("context_source", F.lit("operator-declared")).alias("context_source")
    apps = doc.select(source, F.posexplode("applications").alias("ord", "a")).select(
        "context_source", "ord", "a.*")
    defaults = {"owner": "unassigned", "business_unit": "unassigned",
                "environment": "production", "criticality": "important",
                "exposure": "internal", "data_classification": "internal",
                "data_lifetime_years": 3, "description": "", "business_function": ""}
    empty = F.array().cast("array<string>")

    def items(name: str, column: str) -> DataFrame:
        return apps.select("app_id", "ord", F.posexplode(name).alias("pos", column)).select(
            "app_id", column, (F.col("ord").cast("bigint") * 1000000 + F.col("pos")).alias("ord"))

    repos = items("repositories", "repository")
    if repo_root:
        repos = repos.withColumn("repository", F.concat_ws("/", F.lit(repo_root), "repository"))
    binding = lambda name: doc.select(F.explode(name).alias("basename", "app_id"))
    flat = apps.fillna(defaults).withColumn("regulatory", F.coalesce("regulatory", empty))
    return Estate(
        flat.drop("repositories", "containers", "services"), repos,
        items("services", "service").drop("ord"), items("containers", "container"),
        binding("certificate_bindings"), binding("binary_bindings"))
