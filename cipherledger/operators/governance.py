"""Remediation transitions and audited field overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..knowledge import policy as pol

ORDER = {s: i for i, s in enumerate(pol.REMEDIATION)}

# Override field -> column that suppresses recomputation of the field.
OVERRIDE_COLUMNS = {
    "migration_effort": "effort_override", "migration_months": "months_override",
    "crypto_agility": "agility_override", "interoperability": "interoperability_override",
    "data_lifetime_years": "data_lifetime_years", "data_classification": "data_classification",
    "business_criticality": "business_criticality", "exposure": "exposure",
    "owner": "owner", "business_unit": "business_unit", "triage_state": "triage_state",
}


def _with_previous(events: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Previous ``value`` per key in (ts, event_id) order.

    The order is cut into days: a window works within one key and day, and the first row
    of a day takes the last value of the key's day before, from a small per-day table. A
    key that holds a third of all events is so spread over its days.
    """
    e = events.withColumn("_day", F.to_date("ts"))
    days = e.groupBy(*keys, "_day").agg(F.max_by(value, F.struct("ts", "event_id")).alias("_last"))
    prior = days.withColumn("_prior", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day"))).drop("_last")
    within = Window.partitionBy(*keys, "_day").orderBy("ts", "event_id")
    return (e.withColumn("_lag", F.lag(value).over(within)).join(prior, [*keys, "_day"])
            .withColumn(name, F.coalesce("_lag", "_prior")).drop("_lag", "_prior", "_day"))


def transitions(events: DataFrame, initial: str = "detected") -> DataFrame:
    """Audit rows (from, to, direction) of status events (asset_id, ts, event_id, to,
    actor, note). Events of one asset are ordered by time."""
    e = _with_previous(events, ["asset_id"], "to", "from").withColumn("from", F.coalesce("from", F.lit(initial)))
    forward = lookup(F.col("to"), ORDER) >= lookup(F.col("from"), ORDER)
    return e.withColumn("direction", F.when(forward, "forward").otherwise("backward"))


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per asset, as a partial aggregate."""
    return events.groupBy("asset_id").agg(
        F.max_by("to", F.struct("ts", "event_id")).alias("remediation_status"),
        F.count(F.lit(1)).alias("transitions"))


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """Latest value of each overridden field, one column per field."""
    last = overrides.groupBy("asset_id", "field").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("asset_id").agg(*[
        F.max(F.when(F.col("field") == f, F.col("value"))).alias("o_" + f) for f in OVERRIDE_COLUMNS])


def override_audit(overrides: DataFrame, assets: DataFrame) -> DataFrame:
    """Every override with the value it replaced: the one before it, or the asset's."""
    fields = [f for f in OVERRIDE_COLUMNS if f in assets.columns]
    current = assets.select("asset_id", *[F.col(f).cast("string").alias("current_" + f) for f in fields])
    now = F.coalesce(*[F.when(F.col("field") == f, F.col("current_" + f)) for f in fields])
    return (_with_previous(overrides, ["asset_id", "field"], "value", "earlier").join(current, "asset_id")
            .withColumn("previous", F.coalesce("earlier", now))
            .drop("earlier", *["current_" + f for f in fields]))


def apply_overrides(assets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides win over context and suppress recomputation; overridden assets are
    operator-declared. Apply before assessment."""
    latest = latest_overrides(overrides).withColumn("overridden", F.lit(True))
    a = assets.join(latest, "asset_id", "left")
    for field, column in OVERRIDE_COLUMNS.items():
        value = F.col("o_" + field)
        if column in assets.columns:
            a = a.withColumn(column, F.coalesce(value.cast(assets.schema[column].dataType), F.col(column)))
        else:
            a = a.withColumn(column, value.cast("int") if column == "months_override" else value)
    return a.withColumns({
        "internet_exposed": F.coalesce(F.col("exposure").isin("external-facing", "internet-facing-critical"), F.lit(False)),
        "context_source": F.when(F.col("overridden"), "operator-declared").otherwise(F.col("context_source")),
    }).drop("overridden", *["o_" + f for f in OVERRIDE_COLUMNS])
