"""Data-lifetime urgency under one or many time horizons, and migration priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import case, lookup
from ..knowledge import algorithms as kb
from ..knowledge import policy as pol
from ..knowledge.tables import dimension

SCENARIO_COLUMNS = ("label", "crqc_year", "s_lifetime", "s_months", "safety_margin")


def scenario_table(spark: SparkSession, rows=None) -> DataFrame:
    """Scenarios as rows of (label, crqc_year, lifetime override, months override,
    safety margin in years)."""
    rows = rows or [(f"crqc-{y}", y, None, None, 1.0) for y in pol.CRQC_YEARS]
    df = dimension(spark, rows, SCENARIO_COLUMNS)
    return df.select("label", F.col("crqc_year").cast("int"), F.col("s_lifetime").cast("int"),
                     F.col("s_months").cast("int"), F.col("safety_margin").cast("double"))


def fractional_year(ts: Column) -> Column:
    return F.year(ts).cast("double") + (F.dayofyear(ts) - 1) / F.lit(365.25)


def with_urgency(assets: DataFrame, as_of: Column) -> DataFrame:
    """x + y + margin against z. Needs the scenario columns."""
    now = fractional_year(as_of)
    c = F.col
    lifetime = F.coalesce("s_lifetime", "data_lifetime_years", F.lit(3)).cast("double")
    own = F.when(c("migration_months") != 0, c("migration_months"))
    months = F.coalesce(c("s_months"), own, lookup(c("migration_effort"), pol.EFFORT_MONTHS), F.lit(12))
    a = assets.withColumns({
        "x_years": lifetime, "y_years": months / F.lit(12.0),
        "z_years": c("crqc_year").cast("double") - now})
    gap = (c("x_years") + c("y_years") + c("safety_margin")) - c("z_years")
    deadline = c("crqc_year").cast("double") - c("x_years") - c("y_years") - c("safety_margin")
    until = deadline - now
    urgency = case(
        (~c("quantum_vulnerable"), "not-applicable"),
        ((gap > 0) & (until < -2), "already-late"), (gap > 0, "critical"),
        (until <= 2, "urgent"), (until <= 5, "plan-now"), otherwise="monitor")
    two = lambda col: F.rint(col * 100.0) / 100.0
    return a.withColumns({
        "mosca_urgency": urgency,
        "mosca_gap_years": F.when(c("quantum_vulnerable"), two(gap)).otherwise(0.0),
        "latest_start_year": F.when(c("quantum_vulnerable"), F.rint(deadline * 10.0) / 10.0)
        .otherwise(c("crqc_year").cast("double")),
    }).withColumns({"x_years": two(c("x_years")), "y_years": two(c("y_years")), "z_years": two(c("z_years"))})


def with_priority(assets: DataFrame) -> DataFrame:
    score = F.least(F.lit(100.0), F.col("risk_score")
                    * lookup(F.col("mosca_urgency"), pol.URGENCY_MULTIPLIER, 1.0))
    band = case((score >= 78, "P0"), (score >= 58, "P1"), (score >= 38, "P2"), otherwise="P3")
    broken = F.col("quantum_class") == kb.BROKEN
    return assets.withColumns({
        "migration_priority": F.rint(score).cast("int"),
        "priority_band": F.when(broken & band.isin("P2", "P3"), "P1").otherwise(band)})


def apply_scenarios(assets: DataFrame, scenarios: DataFrame, as_of: Column) -> DataFrame:
    """Every asset under every scenario: a cross join with a handful of rows, then a
    row-wise projection. Nothing upstream is recomputed."""
    return with_priority(with_urgency(assets.crossJoin(scenarios), as_of))


def apply_scenario(assets: DataFrame, as_of: Column, crqc_year: int = pol.DEFAULT_CRQC_YEAR,
                   lifetime: int | None = None, months: int | None = None,
                   margin: float = 1.0, label: str = "default") -> DataFrame:
    a = assets.withColumns({
        "label": F.lit(label), "crqc_year": F.lit(crqc_year),
        "s_lifetime": F.lit(lifetime).cast("int"), "s_months": F.lit(months).cast("int"),
        "safety_margin": F.lit(float(margin))})
    return with_priority(with_urgency(a, as_of)).drop(*SCENARIO_COLUMNS)
