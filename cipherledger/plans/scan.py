"""One scan: stage tables written once and read by every query on it."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..knowledge import policy as pol
from ..operators import agility, decisions, graph, impact, normalize, risk, roadmap, urgency
from ..session import write_stage


#: Columns of decided assets that prerequisites, impacts, the roadmap and their reports read.
READ = ("asset_id", "asset_name", "application", "owner", "business_unit", "repository", "file", "line", "container", "algorithm",
        "library", "library_version", "protocol", "protocol_version", "certificate_serial", "certificate_subject",
        "certificate_issuer", "certificate_self_signed", "days_to_expiry", "tags", "cryptographic_role", "quantum_class",
        "quantum_vulnerable", "classical_risk", "quantum_exposure", "confidence", "context_source", "triage_state",
        "business_criticality", "pqc_readiness", "crypto_agility", "mosca_urgency", "migration_priority", "priority_band",
        "migration_decision", "recommended_strategy", "recommended_pqc", "recommended_hybrid", "migration_effort",
        "migration_months", "migration_blockers")


class Scan:
    """Stages of one run over a detection table. Each is computed on first use; what is
    dear to compute is kept as a stage table. Derived detections, and the wide rows made of
    them, take far more room than the tables they come from: these are not stored but
    derived again, and only narrow tables are kept."""

    def __init__(self, detections: DataFrame | normalize.Derived, estate, as_of: Column,
                 policy: str = pol.DEFAULT_POLICY, crqc_year: int = pol.DEFAULT_CRQC_YEAR):
        self._detections, self.estate, self.as_of = detections, estate, as_of
        self.policy, self.crqc_year = policy, crqc_year

    @cached_property
    def detections(self) -> DataFrame:
        if self.derived:
            return self._detections.detections
        return write_stage(self._detections, "detections")

    @property
    def derived(self) -> bool:
        return isinstance(self._detections, normalize.Derived)

    @cached_property
    def places(self) -> DataFrame:
        """Where files and containers lie."""
        rows = self._detections.pairs if self.derived else self.detections
        return write_stage(normalize.found_places(rows, self.estate), "places")

    @cached_property
    def assets(self) -> DataFrame:
        """Canonical assets with business context."""
        if self.derived:
            return normalize.whole(self.asset_parts)
        return write_stage(normalize.normalize(self.detections, self.estate), "assets")

    @cached_property
    def bound(self):
        """The estate with its applications stored, whose real size spares the assets a shuffle."""
        return replace(self.estate, applications=write_stage(self.estate.applications, "applications"))

    @cached_property
    def asset_parts(self) -> list[DataFrame]:
        """Assets in one or more tables, each with the column it is dealt by."""
        if self.derived:
            return normalize.normalize_parts(self._detections, self.bound, self.places)
        return [self.assets]

    @property
    def provenance(self) -> DataFrame:
        """asset_id -> sentence naming its first detections."""
        if self.derived:
            parts = normalize.normalize_parts(self._detections, self.bound, self.places, chains=True)
            return normalize.told(normalize.whole(parts), "also_chain")
        return normalize.provenance(normalize.evidence_rows(self.detections, self.estate), self.assets)

    @cached_property
    def coupling(self) -> graph.Coupling:
        return graph.coupling(graph.links(self.asset_parts), self.estate)

    @cached_property
    def central_parts(self) -> list[DataFrame]:
        return [graph.with_coupling(p, self.coupling) for p in self.asset_parts]

    @cached_property
    def central(self) -> DataFrame:
        if self.derived:
            return normalize.whole(self.central_parts)
        return write_stage(normalize.whole(self.central_parts), "central")

    @property
    def assessed(self) -> DataFrame:
        """Assets with both axes, the score, agility and interoperability (row-wise)."""
        return self.assess(self.assets)

    def assess(self, assets: DataFrame) -> DataFrame:
        return agility.assess_agility(risk.assess(risk.with_policy(assets, self.policy)))

    @property
    def certified(self) -> DataFrame:
        """Assets of certificates."""
        a = normalize.whole(self.asset_parts[1:]) if self.derived else self.assets
        return a.where("certificate_serial IS NOT NULL")

    @property
    def prioritised(self) -> DataFrame:
        return urgency.apply_scenario(self.assessed, self.as_of, self.crqc_year)

    @property
    def outcomes(self) -> DataFrame:
        """Decisions of assets (row-wise), without what their coupling adds."""
        return decisions.decide(self.prioritised).drop("dependency_centrality", "decision_notes", "decision_rationale")

    @cached_property
    def decided(self) -> DataFrame:
        if self.derived:
            return normalize.whole(self.decided_parts)
        return write_stage(self._decide(self.central), "decided")

    @property
    def decided_parts(self) -> list[DataFrame]:
        return [self._decide(p) for p in self.central_parts] if self.derived else [self.decided]

    @property
    def explained(self) -> DataFrame:
        """Decided assets with ``provenance``, told where their detections are merged."""
        if not self.derived:
            told = normalize.provenance(normalize.evidence_rows(self.detections, self.estate), self.assets, "gkey")
            return self.decided.join(told, "gkey", "left")
        parts = normalize.normalize_parts(self._detections, self.bound, self.places, chains=True)
        parts = [p.withColumn("provenance", normalize.sentence("also_chain")).drop("also_chain") for p in parts]
        return normalize.whole([self._decide(graph.with_coupling(p, self.coupling)) for p in parts])

    def _decide(self, central: DataFrame) -> DataFrame:
        a = agility.assess_agility(risk.assess(risk.with_policy(central, self.policy)))
        return decisions.decide(urgency.apply_scenario(a, self.as_of, self.crqc_year))

    @cached_property
    def judged(self) -> DataFrame:
        """Decided assets as prerequisites, impacts and the roadmap read them, without what
        coupling adds. Derived assets are derived once for all of these and kept as narrow
        rows; their order is that of certificates only, which alone is read."""
        if not self.derived:
            return self.decided
        order = F.when(F.col("certificate_serial") != "", F.col("asset_seq")).alias("asset_seq")
        return write_stage(normalize.whole([self._decide(p).select(*READ, order) for p in self.asset_parts]), "judged")

    @property
    def judged_parts(self) -> list[DataFrame]:
        """Stored rows as they are joined: on their file, or their certificate's serial."""
        inside, c = F.col("certificate_serial").isNull(), F.col
        return [self.judged.where(inside).withColumn("by_file", c("file")),
                self.judged.where(~inside).withColumn("by_dealt", c("certificate_serial"))]

    @property
    def gated(self) -> DataFrame:
        """Assets with their resources, and which of them gate others or wait."""
        return impact.with_gates(impact.with_places(self.judged))

    @cached_property
    def impacts(self) -> DataFrame:
        if not self.derived:
            return impact.build_impacts(self.decided, self.estate)
        coupled = graph.coupling(graph.links(self.judged_parts), self.estate)
        return impact.build_impacts([graph.with_coupling(p, coupled) for p in self.judged_parts], self.estate, self.gated)

    @cached_property
    def items(self) -> DataFrame:
        return roadmap.build_items(self.impacts)

    @cached_property
    def nodes(self) -> DataFrame:
        if self.derived:
            return graph.listed_nodes(graph.node_lines(self.asset_parts), self.estate)
        return write_stage(graph.nodes(self.assets, self.estate), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        if self.derived:
            return graph.listed_edges(graph.asset_lines(self.asset_parts), self.estate)
        return write_stage(graph.edges(self.assets, self.estate), "edges")

    @cached_property
    def evidence(self) -> DataFrame:
        return write_stage(normalize.evidence_table(self.detections, self.assets, self.estate), "evidence")
