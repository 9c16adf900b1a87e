"""Registered queries: one per operator family, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_tenth
from ..knowledge import policy as pol
from ..operators import agility, certificates, decisions, normalize, risk, rollups, urgency
from ..session import tune
from ..sources import driver_tables as dt
from ..sources import files as fs
from . import oracle_base as o
from .scan import Scan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_SCANS: dict = {}


def scan(spark: SparkSession, sf_dir: str) -> Scan:
    """One scan per session and input; its stage tables serve all queries."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCANS:
        _SCANS[key] = Scan(dt.derived(spark, sf_dir), dt.estate(spark, sf_dir),
                           F.lit(dt.AS_OF).cast("timestamp"))
    return _SCANS[key]


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def text(name: str) -> F:
    """Array column as one comparable string."""
    return F.array_join(name, "; ").alias(name)


# --- sources and detections --------------------------------------------------------------
@register("certificate_detections", o.query(o.CERT_CTE, """
SELECT file, algorithm, role, key_size, curve, matched, cert_component, oid, serial, days AS days_to_expiry FROM cert_d"""))
def certificate_detections(spark, sf) -> DataFrame:
    tune(spark)
    rows = dt.certificates(spark, sf).repartition("file")  # few splits, much work on a row
    d = certificates.certificate_detections(rows, F.lit(dt.AS_OF).cast("timestamp"))
    return d.select("file", "algorithm", "role", "key_size", "curve", "matched", "cert_component", "oid",
                    F.col("certificate.serial").alias("serial"), F.col("certificate.days_to_expiry").alias("days_to_expiry"))


@register("detection_counts", o.query(o.DETS_CTE, "SELECT detector, count(*) AS detections FROM dets GROUP BY detector"))
def detection_counts(spark, sf) -> DataFrame:
    return fs.detector_counts(scan(spark, sf).detections)


@register("scan_dedup_stats", o.query(o.ASSETS_CTE, """
SELECT (SELECT count(*) FROM dets) AS raw_detections, count(*) AS assets, (SELECT count(*) FROM dets) - count(*) AS deduplicated,
  count(DISTINCT p_repository) AS repositories FROM assets"""))
def scan_dedup_stats(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    raw = s.detections.agg(F.count(F.lit(1)).alias("raw_detections"))
    return s.assets.agg(F.count(F.lit(1)).alias("assets"), F.count_distinct("repository").alias("repositories")).crossJoin(raw).select(
        "raw_detections", "assets", (F.col("raw_detections") - F.col("assets")).alias("deduplicated"), "repositories")


@register("provider_capability", o.query(o.DETS_CTE, """
SELECT library, library_version, cap AS pqc_capability, count(*) AS n FROM dets WHERE cap IS NOT NULL GROUP BY ALL"""))
def provider_capability(spark, sf) -> DataFrame:
    return (scan(spark, sf).detections.where("pqc_capability IS NOT NULL")
            .groupBy("library", "library_version", "pqc_capability").agg(F.count(F.lit(1)).alias("n")))


@register("estate_applications", o.query(o.ASSETS_CTE, """
SELECT app_id, name, owner, business_unit, criticality, exposure, data_classification, data_lifetime_years,
  (SELECT count(DISTINCT repo) FROM repos WHERE app = app_id) AS repositories,
  (SELECT count(DISTINCT cont) FROM conts WHERE app = app_id) AS containers FROM apps"""))
def estate_applications(spark, sf) -> DataFrame:
    e = scan(spark, sf).estate
    repos = e.repositories.groupBy("app_id").agg(F.count_distinct("repository").alias("repositories"))
    conts = e.containers.groupBy("app_id").agg(F.count_distinct("container").alias("containers"))
    return (e.applications.join(repos, "app_id", "left").join(conts, "app_id", "left").fillna(0, ["repositories", "containers"])
            .select("app_id", "name", "owner", "business_unit", "criticality", "exposure", "data_classification",
                    "data_lifetime_years", "repositories", "containers"))


# --- normalisation -----------------------------------------------------------------------
@register("repository_attribution", o.query(o.ATTR_CTE, """
SELECT file, container, repository, application, count(*) AS detections FROM att GROUP BY ALL"""))
def repository_attribution(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    a = normalize.attribute(s.detections, s.estate.repositories, s.estate.containers)
    return a.groupBy("file", "container", "repository", "application").agg(F.count(F.lit(1)).alias("detections"))


@register("merged_assets", o.query(o.ASSETS_CTE, """
SELECT asset_id, asset_type, asset_name, p_file AS file, p_line AS line, p_language AS language, algorithm, kb_family AS algorithm_family, key_size, curve, mode, padding,
  cryptographic_role, protocol, protocol_version, library, library_version, package, pqc_readiness, confidence, evidence_type,
  duplicate_count, detectors FROM assets"""))
def merged_assets(spark, sf) -> DataFrame:
    return scan(spark, sf).assets.select(
        "asset_id", "asset_type", "asset_name", "file", "line", "language", "algorithm", "algorithm_family", "key_size", "curve", "mode",
        "padding", "cryptographic_role", "protocol", "protocol_version", "library", "library_version", "package",
        "pqc_readiness", "confidence", "evidence_type", F.col("duplicate_count").cast("bigint").alias("duplicate_count"),
        F.array_join("detectors", ",").alias("detectors"))


@register("asset_strength", o.query(o.RISK_CTE, """
SELECT asset_id, security_strength, quantum_strength, quantum_class, quantum_vulnerable, classical_security_status FROM risk"""))
def asset_strength(spark, sf) -> DataFrame:
    return scan(spark, sf).assessed.select("asset_id", "security_strength", "quantum_strength", "quantum_class",
                                           "quantum_vulnerable", "classical_security_status")


@register("asset_tags", o.query(o.ASSETS_CTE, """
SELECT asset_id, array_to_string(tags, '; ') AS tags, coalesce(proves_use, false) AS proves_use FROM assets"""))
def asset_tags(spark, sf) -> DataFrame:
    return scan(spark, sf).assets.select("asset_id", text("tags"), "proves_use")


@register("business_context", o.query(o.ASSETS_CTE, """
SELECT asset_id, application, owner, business_unit, data_classification, data_lifetime_years, business_criticality, exposure, internet_exposed,
  usage, regulatory AS compliance_tags, context_source FROM assets"""))
def business_context(spark, sf) -> DataFrame:
    return scan(spark, sf).assets.select(
        "asset_id", "application", "owner", "business_unit", "data_classification", "data_lifetime_years", "business_criticality",
        "exposure", "internet_exposed", "usage", text("compliance_tags"), "context_source")


LOCATION = """CASE WHEN file <> '' AND line <> 0 THEN file || ':' || line WHEN file <> '' THEN file ELSE coalesce(container, 'n/a') END"""


@register("evidence_items", o.query(o.ASSETS_CTE, f"""
SELECT a.asset_id, k.detector, k.method, k.evidence_type, k.confidence, {LOCATION.replace('file', 'k.file').replace('line', 'k.line').replace('container', 'k.container')} AS location, k.matched, coalesce(k.proves, false) AS proves
FROM keyed k JOIN assets a ON k.gkey = a.gkey"""))
def evidence_items(spark, sf) -> DataFrame:
    return scan(spark, sf).evidence.select("asset_id", "detector", "method", "evidence_type", "confidence", "location", "matched", "proves")


@register("asset_provenance", o.query(o.ASSETS_CTE, f"""
, ranked AS (SELECT gkey, detector || '(' || method || ')' AS d, row_number() OVER (PARTITION BY gkey ORDER BY {o.ORDER}) AS n FROM keyed),
chains AS (SELECT gkey, string_agg(d, ' + ' ORDER BY n) AS chain FROM ranked WHERE n <= 4 GROUP BY gkey)
SELECT asset_id, duplicate_count || ' detection(s) via ' || chain || CASE WHEN duplicate_count > 4 THEN ' +' || (duplicate_count - 4) || ' more' ELSE '' END
  || '; highest confidence ' || confidence || '; ' || CASE WHEN proves_use THEN 'evidence shows the algorithm is reachable'
  ELSE 'presence inferred from linkage, packaging or lexical context only' END AS provenance FROM assets JOIN chains USING (gkey)"""))
def asset_provenance(spark, sf) -> DataFrame:
    return scan(spark, sf).provenance


# --- risk --------------------------------------------------------------------------------
@register("classical_axis", o.query(o.RISK_CTE, "SELECT asset_id, classical_risk, classical_trigger FROM risk"))
def classical_axis(spark, sf) -> DataFrame:
    return scan(spark, sf).assessed.select("asset_id", "classical_risk", "classical_trigger")


@register("quantum_axis", o.query(o.RISK_CTE, "SELECT asset_id, quantum_exposure, quantum_trigger, harvest_now FROM risk"))
def quantum_axis(spark, sf) -> DataFrame:
    return scan(spark, sf).assessed.select("asset_id", "quantum_exposure", "quantum_trigger", "harvest_now")


@register("risk_scores", o.query(o.RISK_CTE, "SELECT asset_id, risk_score, risk_band, migration_effort, migration_months FROM risk"))
def risk_scores(spark, sf) -> DataFrame:
    return scan(spark, sf).assessed.select("asset_id", "risk_score", "risk_band", "migration_effort", "migration_months")


@register("risk_factor_table", o.query(o.RISK_CTE, """
, f AS (SELECT asset_id, unnest(['algorithm_exposure', 'data_lifetime', 'data_sensitivity', 'exposure', 'business_criticality', 'migration_effort']) AS name,
  unnest([exposure_raw, life_raw, sens_raw, exp_raw, crit_raw, effort_raw]) AS raw, unnest([0.3, 0.2, 0.18, 0.14, 0.12, 0.06]::DOUBLE[]) AS weight FROM risk)
SELECT asset_id, name, raw, weight, raw * weight AS contribution FROM f"""))
def risk_factor_table(spark, sf) -> DataFrame:
    return scan(spark, sf).assessed.select("asset_id", F.explode("risk_factors").alias("f")).select("asset_id", "f.*")


@register("policy_comparison", o.query(o.ASSETS_CTE, " UNION ALL ".join(f"""
SELECT '{p[0]}' AS policy_id, classical_risk, quantum_exposure, count(*) AS n FROM (SELECT {o.axes(str(p[2]), str(p[3]), str(p[4]))} FROM assets) GROUP BY ALL""" for p in pol.POLICIES)))
def policy_comparison(spark, sf) -> DataFrame:
    a = risk.for_each_policy(scan(spark, sf).assets)
    return (a.select("policy_id", risk.classical_axis().alias("c"), risk.quantum_axis().alias("q"))
            .groupBy("policy_id", F.col("c.band").alias("classical_risk"), F.col("q.band").alias("quantum_exposure"))
            .agg(F.count(F.lit(1)).alias("n")))


# --- agility, urgency, priority ----------------------------------------------------------
@register("agility_and_interoperability", o.query(o.RISK_CTE, "SELECT asset_id, agility_points, crypto_agility, interoperability FROM risk"))
def agility_and_interoperability(spark, sf) -> DataFrame:
    return scan(spark, sf).assessed.select("asset_id", "agility_points", "crypto_agility", "interoperability")


@register("migration_urgency", o.query(o.URGENCY_CTE, "SELECT asset_id, mosca_urgency, mosca_gap_years, latest_start_year FROM urgent"))
def migration_urgency(spark, sf) -> DataFrame:
    return scan(spark, sf).prioritised.select("asset_id", "mosca_urgency", "mosca_gap_years", "latest_start_year")


@register("migration_priority", o.query(o.URGENCY_CTE, "SELECT asset_id, migration_priority, priority_band FROM urgent"))
def migration_priority(spark, sf) -> DataFrame:
    return scan(spark, sf).prioritised.select("asset_id", "migration_priority", "priority_band")


@register("scenario_sweep", o.query(o.RISK_CTE, f"""
, years AS (SELECT unnest({list(pol.CRQC_YEARS)}) AS crqc_year), swept AS (SELECT *, {o.urgency_columns('crqc_year')} FROM risk CROSS JOIN years)
SELECT 'crqc-' || crqc_year AS label, mosca_urgency, {o.BAND} AS priority_band, count(*) AS n FROM swept GROUP BY ALL"""))
def scenario_sweep(spark, sf) -> DataFrame:
    s = scan(spark, sf)
    swept = urgency.apply_scenarios(s.assessed, urgency.scenario_table(spark), s.as_of)
    return swept.groupBy("label", "mosca_urgency", "priority_band").agg(F.count(F.lit(1)).alias("n"))


@register("top_assets_per_application", o.query(o.URGENCY_CTE, """
, r AS (SELECT application, asset_id, asset_name, migration_priority, priority_band, risk_score,
  row_number() OVER (PARTITION BY application ORDER BY migration_priority DESC, asset_id) AS rank FROM urgent WHERE application IS NOT NULL)
SELECT * FROM r WHERE rank <= 20"""))
def top_assets_per_application(spark, sf) -> DataFrame:
    from pyspark.sql import Window
    a = scan(spark, sf).prioritised.where("application IS NOT NULL").select(
        "application", "asset_id", "asset_name", "migration_priority", "priority_band", "risk_score")
    w = Window.partitionBy("application").orderBy(F.desc("migration_priority"), "asset_id")
    return a.withColumn("rank", F.row_number().over(w)).where("rank <= 20")


# --- decisions ---------------------------------------------------------------------------
@register("migration_strategy", o.query(o.DECIDE_CTE, "SELECT asset_id, recommended_action, rule FROM decided"))
def migration_strategy(spark, sf) -> DataFrame:
    return scan(spark, sf).outcomes.select("asset_id", "recommended_action", "rule")


@register("migration_decisions", o.query(o.DECIDE_CTE, """
SELECT asset_id, migration_decision, recommended_strategy, recommended_pqc, recommended_hybrid, decision_blocked_on FROM decided"""))
def migration_decisions(spark, sf) -> DataFrame:
    return scan(spark, sf).outcomes.select("asset_id", "migration_decision", "recommended_strategy", "recommended_pqc",
                                          "recommended_hybrid", "decision_blocked_on")


@register("alternative_targets", o.query(o.DECIDE_CTE, """
SELECT asset_id, CASE WHEN rule = 'classically-broken' THEN CASE WHEN kb_primitive IN ('hash', 'mac') THEN 'SHA-256 or SHA-384' ELSE 'AES-256-GCM' END
  WHEN rule = 'below-floor' THEN CASE WHEN kb_primitive = 'hash' THEN 'SHA-384' ELSE 'AES-256-GCM' END
  WHEN rule IN ('key-establishment', 'signature') THEN t_alternative END AS alternative FROM decided"""))
def alternative_targets(spark, sf) -> DataFrame:
    return scan(spark, sf).outcomes.select("asset_id", "alternative")


@register("migration_advice", o.query(o.DECIDE_CTE, f"""
SELECT asset_id, replace({o.cmap('rule', o.RULE_STEPS, "''")}, ' ', '; ') AS migration_steps,
  replace(CASE WHEN rule = 'classically-broken' AND algorithm = 'rc4' THEN 'SP800131A SP80057 RFC7465'
    WHEN rule = 'post-quantum' THEN CASE WHEN kb_primitive = 'kem' THEN 'FIPS203 NISTPQC' ELSE 'FIPS204 NISTPQC' END
    WHEN rule IN ('key-establishment', 'signature') THEN t_citations ELSE {o.cmap('rule', o.RULE_CITATIONS)} END, ' ', '; ') AS recommendation_citations,
  CASE WHEN rule IN ('rsa-transport', 'key-establishment', 'signature') THEN concat_ws('; ', CASE pqc_readiness WHEN 'none' THEN 'replace-provider' WHEN 'provider' THEN 'upgrade-provider' END,
      CASE WHEN {o.OLD} THEN 'upgrade-to-tls-1.3' END, CASE WHEN asset_type = 'certificate' THEN 'confirm-ca-support' WHEN asset_type = 'binary-artifact' THEN 'vendor-roadmap-or-rebuild' END)
    WHEN rule IN ('provider-without-path', 'provider-unconfirmed') THEN 'upgrade-or-replace: ' || coalesce(lib_name, library) ELSE '' END AS advice_prerequisites,
  CASE WHEN rule IN ('key-establishment', 'signature') THEN concat_ws('; ', CASE WHEN fam = 'key-establishment' THEN 'larger-handshakes' END,
      CASE WHEN fam = 'signature' AND t_primary LIKE 'SLH-DSA%' THEN 'large-slow-signatures' END, CASE WHEN confidence <> 'high' THEN 'confirm-evidence-first' END)
    ELSE coalesce(CASE rule WHEN 'exposed-key' THEN 'presence-only-no-key-bytes' WHEN 'classically-broken' THEN 'present-tense-exposure' WHEN 'meets-floor' THEN 'quadratic-speedup-only'
      WHEN 'below-floor' THEN 'no-pqc-substitute-for-symmetric' WHEN 'role-unknown' THEN 'target-depends-on-role' WHEN 'rsa-transport' THEN 'protocol-semantics-change' END, '') END AS advice_caveats
FROM decided"""))
def migration_advice(spark, sf) -> DataFrame:
    return scan(spark, sf).outcomes.select("asset_id", text("migration_steps"), text("recommendation_citations"),
                                          text("advice_prerequisites"), text("advice_caveats"))


@register("migration_blockers", o.query(o.DECIDE_CTE, f"""
SELECT asset_id, concat_ws('; ', CASE pqc_readiness WHEN 'none' THEN 'replace-provider: ' || coalesce(library, 'unknown library')
    WHEN 'provider' THEN 'upgrade-provider: ' || concat_ws(' ', coalesce(library, 'unknown library'), library_version) END,
  CASE WHEN {o.OLD} THEN 'enable-tls-1.3' END, CASE WHEN asset_type = 'certificate' THEN 'confirm-ca-support' WHEN asset_type = 'binary-artifact' THEN 'vendor-roadmap-or-rebuild' END,
  CASE WHEN t_key THEN 'rotate-exposed-key' END, CASE WHEN t_blocker THEN 'externalise-algorithm-choice' END,
  CASE WHEN cryptographic_role = 'unknown' AND quantum_vulnerable THEN 'determine-role' END) AS migration_blockers FROM decided"""))
def migration_blockers(spark, sf) -> DataFrame:
    return scan(spark, sf).outcomes.select("asset_id", text("migration_blockers"))


@register("decision_summary", o.query(o.DECIDE_CTE, f"""
, d AS (SELECT * FROM (VALUES ('RETAIN', 0), ('HARDEN', 1), ('UPGRADE', 2), ('HYBRID', 3), ('PQC-ONLY', 4)) AS t(migration_decision, rank))
SELECT d.migration_decision, rank, count(asset_id) AS assets, count(decision_blocked_on) AS blocked FROM d LEFT JOIN decided USING (migration_decision) GROUP BY ALL"""))
def decision_summary(spark, sf) -> DataFrame:
    return decisions.decision_summary(scan(spark, sf).outcomes)


@register("strategy_summary", o.query(o.DECIDE_CTE, "SELECT recommended_strategy, count(*) AS assets FROM decided GROUP BY ALL"))
def strategy_summary(spark, sf) -> DataFrame:
    return decisions.strategy_summary(scan(spark, sf).outcomes)
