"""Stage chains without stored results, for callers that need a single table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..knowledge import policy as pol
from ..operators import agility, decisions, normalize, risk, urgency


def assessed_assets(detections: DataFrame, estate, policy: str = pol.DEFAULT_POLICY,
                    weights: dict | None = None) -> DataFrame:
    """Canonical assets with both axes, score, agility and interoperability."""
    assets = risk.with_policy(normalize.normalize(detections, estate), policy)
    return agility.assess_agility(risk.assess(assets, weights))


def decided_assets(detections: DataFrame, estate, as_of: Column,
                   policy: str = pol.DEFAULT_POLICY,
                   crqc_year: int = pol.DEFAULT_CRQC_YEAR) -> DataFrame:
    """Assets with decisions, fully lazy; coupling notes need the centrality stage."""
    assets = assessed_assets(detections, estate, policy)
    return decisions.decide(urgency.apply_scenario(assets, as_of, crqc_year))
