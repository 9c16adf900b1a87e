"""Turn fixed Python rows into SQL ``VALUES`` relations.

A ``VALUES`` relation is planned as a local relation with an exact size, so the
optimizer knows a dimension is small without being told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows, columns, alias: str = "t") -> str:
    """``(VALUES ...) AS alias(columns)``, valid in Spark SQL and in ANSI SQL."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(columns)})"


def dimension(spark: SparkSession, rows, columns) -> DataFrame:
    """A fixed dimension, hinted for broadcast: its rows are literals in this package,
    so its size is known when the code is written and does not grow with the data."""
    # Spark reads a doubled quote as an adjacent literal, so escape with a backslash.
    sql = values_sql(rows, columns).replace("\\", "\\\\").replace("''", "\\'")
    return F.broadcast(spark.sql(f"SELECT * FROM {sql}"))
