"""Migration strategy, the five decisions, targets, blockers and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case, compact, lookup
from ..functions.packages import capability
from ..knowledge import algorithms as kb
from ..knowledge import policy as pol
from ..knowledge.tables import dimension
from .risk import OLD_TLS, known, tagged

TLS_HYBRID = "X25519MLKEM768"


def role_family() -> Column:
    return lookup(F.col("cryptographic_role"), kb.ROLE_FAMILY, "unknown")


def advice_floor() -> Column:
    """Hash and MAC primitives answer to the hash floor, all others to the symmetric."""
    return F.when(F.col("first_role").isin(kb.HASH, kb.MAC), F.col("min_hash")).otherwise(F.col("min_symmetric"))


def symmetric_advice() -> Column:
    """replace-now, strengthen or retain, by class and policy floor."""
    return case((F.col("quantum_class") == kb.BROKEN, "replace-now"),
                (F.col("security_strength") < advice_floor(), "strengthen"), otherwise="retain")


def is_firmware() -> Column:
    hay = F.lower(F.concat_ws(" ", "file", "application", "usage", "asset_name"))
    return hay.rlike("|".join(pol.FIRMWARE_WORDS))


def strength_tier() -> Column:
    bits = F.when(F.col("security_strength") == 0, 128).otherwise(F.coalesce("security_strength", F.lit(128)))
    return case((bits >= 256, 256), (bits >= 192, 192), otherwise=128)


def with_target(assets: DataFrame) -> DataFrame:
    """Role- and tier-aware target columns (fixed rows, broadcast)."""
    a = assets.withColumns({"role_family": role_family(), "firmware": is_firmware()})
    family = F.when((F.col("role_family") == "signature") & F.col("firmware"), "firmware-signature").otherwise(F.col("role_family"))
    dim = dimension(a.sparkSession, pol.TARGETS, pol.TARGET_COLUMNS)
    a = a.withColumns({"want_family": family, "want_tier": strength_tier()})
    return (a.join(dim, (F.col("want_family") == F.col("t_family"))
                   & (F.col("want_tier") == F.col("t_tier")), "left")
            .drop("t_family", "t_tier", "want_family", "want_tier"))


def strategy() -> Column:
    """struct(code, rule); the first matching rule wins."""
    def out(code, rule):
        code = code if isinstance(code, Column) else F.lit(code)
        return F.struct(code.alias("code"), F.lit(rule).alias("rule"))

    c, q = F.col, F.col("quantum_class")
    has = lambda n: F.coalesce(c(n) != "", F.lit(False))
    proto, ver = c("protocol"), F.coalesce("protocol_version", F.lit(""))
    bare_protocol, bare_library = ~known() & has("protocol"), ~known() & has("library")
    family, role = c("role_family"), c("cryptographic_role")
    # Capability is recomputed from library and version, not read from readiness.
    cap = capability(c("lib_pqc"), c("lib_since"), c("library_version"))
    hybrid_ok = (family == "key-establishment") & c("t_hybrid").isNotNull() & (proto.isNull() | (proto == "TLS"))
    return case(
        (tagged("key-material-exposure"), out("rotate-and-externalise-key", "exposed-key")),
        (bare_protocol & (((proto == "TLS") & ver.isin("1.0", "1.1")) | (proto == "SSL")), out("upgrade-protocol", "legacy-protocol")),
        (bare_protocol & (proto == "TLS") & (ver == "1.2"), out("upgrade-protocol", "tls12")),
        (bare_protocol & (proto == "TLS") & (ver == "1.3"), out("migrate-to-pqt-hybrid", "tls13")),
        (bare_protocol, out("verify-manually", "other-protocol")),
        (bare_library & (cap == "native"), out("retain", "native-provider")),
        (bare_library & (cap == "none"), out("migrate-to-pqc", "provider-without-path")),
        (bare_library, out("verify-manually", "provider-unconfirmed")),
        (~known(), out("verify-manually", "unresolved")),
        (c("days_to_expiry") < 0, out("renew-certificate", "expired")),
        (q == kb.BROKEN, out("replace-now-classical", "classically-broken")),
        (q == kb.PQC, out("retain", "post-quantum")),
        ((q == kb.HYBRID) & (c("algorithm_status") == "deprecated"), out("re-pin-to-standard", "draft-hybrid")),
        (q == kb.HYBRID, out("retain", "hybrid")),
        (q == kb.SELECTED, out("verify-manually", "not-final")),
        ((q == kb.GROVER) & (symmetric_advice() == "retain"), out("retain", "meets-floor")),
        (q == kb.GROVER, out("strengthen-parameters", "below-floor")),
        (role == kb.UNKNOWN, out("determine-role-then-migrate", "role-unknown")),
        (family.isin("hash", "kdf"), out("verify-manually", "role-mismatch")),
        (role.isin(kb.KT, kb.ENC) & (c("algorithm_family") == "RSA"), out("migrate-to-pqc", "rsa-transport")),
        (c("t_primary").isNull(), out("verify-manually", "no-target")),
        (hybrid_ok, out("migrate-to-pqt-hybrid", "key-establishment")),
        (family == "signature", out("migrate-to-pqc", "signature")),
        otherwise=out("migrate-to-pqc", "key-establishment"))


def proposed_targets() -> tuple[Column, Column, Column]:
    """(post-quantum, hybrid, alternative) before the decision is made."""
    rule, c = F.col("rule"), F.col
    by_target = rule.isin("key-establishment", "signature")
    pqc = case((rule.isin("not-final", "rsa-transport"), "ML-KEM-768"), (by_target, c("t_primary")))
    hybrid = case(
        (rule.isin("legacy-protocol", "tls12", "tls13", "draft-hybrid"), TLS_HYBRID),
        ((rule == "rsa-transport") & (c("protocol") == "TLS"), TLS_HYBRID),
        (by_target & (c("recommended_action") == "migrate-to-pqt-hybrid"), c("t_hybrid")))
    weak_hash = c("primitive").isin("hash", "mac")
    alternative = case(
        (rule == "classically-broken", F.when(weak_hash, "SHA-256 or SHA-384").otherwise("AES-256-GCM")),
        (rule == "below-floor", F.when(c("primitive") == "hash", "SHA-384").otherwise("AES-256-GCM")),
        (by_target, c("t_alternative")))
    return pqc, hybrid, alternative


def decision() -> Column:
    """struct(decision, strategy): the mapped decision with its contextual overrides, in
    a fixed order."""
    c = F.col
    action = c("recommended_action")
    mapped = lookup(action, pol.STRATEGY_DECISION, "HARDEN")
    migrates = mapped.isin("HYBRID", "PQC-ONLY")
    provider_only = migrates & c("algorithm").isNull() & F.coalesce(c("library") != "", F.lit(False))
    context = case((c("role_family") == "signature", "PQC-ONLY"), (~c("allow_non_hybrid"), "HYBRID"),
                   (c("interoperability") == "open", "PQC-ONLY"), otherwise="HYBRID")
    final = case((provider_only, "UPGRADE"), (action == "re-pin-to-standard", mapped),
                 (migrates, context), otherwise=mapped)
    realigned = (migrates & ~provider_only
                 & action.isin("migrate-to-pqt-hybrid", "migrate-to-pqc"))
    code = F.when(realigned, F.when(context == "HYBRID", "migrate-to-pqt-hybrid")
                  .otherwise("migrate-to-pqc")).otherwise(action)
    return F.struct(final.alias("decision"), code.alias("strategy"))


def blockers() -> Column:
    c = F.col
    lib = F.coalesce(c("library"), F.lit("unknown library"))
    lib_ver = F.concat_ws(" ", lib, F.when(c("library_version") != "", c("library_version")))
    return compact(
        (c("pqc_readiness") == "none", F.concat(F.lit("replace-provider: "), lib)),
        (c("pqc_readiness") == "provider", F.concat(F.lit("upgrade-provider: "), lib_ver)),
        ((c("protocol") == "TLS") & c("protocol_version").isin(*OLD_TLS), "enable-tls-1.3"),
        (c("asset_type") == "certificate", "confirm-ca-support"),
        (c("asset_type") == "binary-artifact", "vendor-roadmap-or-rebuild"),
        (tagged("key-material-exposure"), "rotate-exposed-key"),
        (tagged("crypto-agility-blocker"), "externalise-algorithm-choice"),
        ((c("cryptographic_role") == kb.UNKNOWN) & c("quantum_vulnerable"), "determine-role"))


def prerequisites() -> Column:
    """Advice-level prerequisites of a concrete target."""
    c = F.col
    concrete = c("rule").isin("rsa-transport", "key-establishment", "signature")
    listed = compact(
        (c("pqc_readiness") == "none", "replace-provider"),
        (c("pqc_readiness") == "provider", "upgrade-provider"),
        ((c("protocol") == "TLS") & c("protocol_version").isin(*OLD_TLS), "upgrade-to-tls-1.3"),
        (c("asset_type") == "certificate", "confirm-ca-support"),
        (c("asset_type") == "binary-artifact", "vendor-roadmap-or-rebuild"))
    provider = c("rule").isin("provider-without-path", "provider-unconfirmed")
    return case((concrete, listed), (provider, F.array(F.concat(
        F.lit("upgrade-or-replace: "), F.coalesce("lib_name", "library")))),
        otherwise=F.array().cast("array<string>"))


def caveats() -> Column:
    c = F.col
    targeted = c("rule").isin("key-establishment", "signature")
    return F.when(targeted, compact(
        (c("role_family") == "key-establishment", "larger-handshakes"),
        ((c("role_family") == "signature") & c("t_primary").startswith("SLH-DSA"), "large-slow-signatures"),
        (~c("allow_non_hybrid") & (c("recommended_action") != "migrate-to-pqt-hybrid"), "policy-exception-needed"),
        (c("confidence") != "high", "confirm-evidence-first"))).otherwise(lookup_caveat())


def lookup_caveat() -> Column:
    rule = F.col("rule")
    return compact(
        (rule == "exposed-key", "presence-only-no-key-bytes"),
        (rule == "classically-broken", "present-tense-exposure"),
        (rule == "meets-floor", "quadratic-speedup-only"),
        (rule == "below-floor", "no-pqc-substitute-for-symmetric"),
        (rule == "role-unknown", "target-depends-on-role"),
        (rule == "rsa-transport", "protocol-semantics-change"))


# Citations of each rule; targeted rules cite their target row.
RULE_CITATIONS = {
    "exposed-key": "CISA_QR", "legacy-protocol": "RFC10024 SP800131A", "tls12": "RFC10024 RFC9954",
    "tls13": "RFC10024", "other-protocol": "CISA_QR", "native-provider": "FIPS203 RFC10024",
    "provider-without-path": "FIPS203 CISA_QR", "provider-unconfirmed": "FIPS203 CISA_QR",
    "unresolved": "CISA_QR", "expired": "CISA_QR", "classically-broken": "SP800131A SP80057",
    "draft-hybrid": "RFC10024 FIPS203", "hybrid": "RFC10024 RFC9954",
    "not-final": "IR8545 NISTPQC FIPS203", "meets-floor": "SP80057 NSA_CNSA2",
    "below-floor": "SP80057 NSA_CNSA2", "role-unknown": "FIPS203 FIPS204 FIPS205",
    "role-mismatch": "FIPS204", "rsa-transport": "FIPS203 RFC10024 IR8547", "no-target": "NISTPQC",
}


def citations() -> Column:
    c = F.col
    rule = lookup(c("rule"), RULE_CITATIONS)
    text = case(
        ((c("rule") == "classically-broken") & (c("algorithm") == "rc4"), "SP800131A SP80057 RFC7465"),
        ((c("rule") == "post-quantum") & (c("primitive") == "kem"), "FIPS203 NISTPQC"),
        (c("rule") == "post-quantum", "FIPS204 NISTPQC"),
        (c("rule").isin("key-establishment", "signature"), c("t_citations")), otherwise=rule)
    return F.split(text, " ")


# Ordered step codes of each rule family.
RULE_STEPS = {
    "exposed-key": "revoke reissue-in-hsm inject-at-runtime purge-history rescan",
    "legacy-protocol": "inventory-clients enable-tls13 disable-legacy enable-hybrid-group rescan",
    "tls12": "enable-tls13 confirm-library add-hybrid-group watch-clienthello deprecate-tls12",
    "tls13": "verify-library add-hybrid-group benchmark enable-in-production",
    "native-provider": "confirm-build enable-hybrid-at-protocol rescan",
    "provider-without-path": "find-sharers plan-provider-upgrade rescan",
    "provider-unconfirmed": "find-sharers plan-provider-upgrade rescan",
    "expired": "renew-or-revoke confirm-unused adopt-stronger-signature monitor-expiry",
    "classically-broken": "replace review-produced-data block-in-ci rescan",
    "post-quantum": "none-required record-as-migrated",
    "draft-hybrid": "add-standard-group keep-draft-briefly remove-draft rescan",
    "not-final": "ensure-final-primary keep-as-hedge track-standard",
    "meets-floor": "none-required keep-inventoried",
    "below-floor": "larger-parameters parameter-change-only rescan",
    "role-unknown": "inspect-call-sites read-key-usage record-role follow-role-path",
    "rsa-transport": "identify-protected-data redesign-as-encapsulation adopt-hybrid-for-tls kem-with-kdf benchmark stage-with-fallback",
    "key-establishment": "introduce-target verify-support benchmark canary progressive-rollout disable-legacy rescan",
    "signature": "introduce-target verify-support benchmark canary progressive-rollout disable-legacy rescan",
}


def steps() -> Column:
    return F.split(lookup(F.col("rule"), RULE_STEPS, ""), " ")


def notes() -> Column:
    """Codes that amplify or qualify a decision."""
    c = F.col
    migrates = c("migration_decision").isin("HYBRID", "PQC-ONLY")
    return compact(
        ((c("recommended_strategy") == "determine-role-then-migrate"), "held-until-role-known"),
        (migrates & c("classical_risk").isin("critical", "high"), "classical-risk-first"),
        (c("mosca_urgency").isin("already-late", "critical"), F.concat(F.lit("window-closed-by-"),
         F.format_string("%.1f", "mosca_gap_years"), F.lit("-years"))),
        (c("dependency_centrality") >= 5, "high-coupling"),
        (c("crypto_agility") == "low", "longer-lead-time"))


def recommend(assets: DataFrame) -> DataFrame:
    """Strategy, proposed targets and advice. Needs policy columns."""
    a = with_target(assets).withColumn("s", strategy())
    a = a.withColumns({"recommended_action": F.col("s.code"), "rule": F.col("s.rule")})
    pqc, hybrid, alternative = proposed_targets()
    return a.withColumns({
        "recommended_pqc": pqc, "recommended_hybrid": hybrid, "alternative": alternative,
        "recommendation_citations": citations(), "migration_steps": steps(),
        "advice_prerequisites": prerequisites(), "advice_caveats": caveats()}).drop("s")


def decide(assets: DataFrame) -> DataFrame:
    """Decision, realigned strategy and coherent targets."""
    a = recommend(assets).withColumn("d", decision())
    a = a.withColumns({"migration_decision": F.col("d.decision"), "recommended_strategy": F.col("d.strategy")})
    kind = F.col("migration_decision")
    retained = kind == "RETAIN"
    hybrid = case((retained | (kind == "PQC-ONLY"), None),
                  (kind == "HYBRID", F.coalesce("recommended_hybrid", "t_hybrid")),
                  otherwise=F.col("recommended_hybrid"))
    if "dependency_centrality" not in a.columns:
        a = a.withColumn("dependency_centrality", F.lit(0))
    a = a.withColumns({
        "recommended_hybrid": hybrid,
        "recommended_pqc": F.when(~retained, F.col("recommended_pqc")),
        "migration_blockers": blockers(),
        "decision_blocked_on": F.when(F.col("recommended_strategy") == "determine-role-then-migrate", "role-determination")})
    a = a.withColumn("decision_notes", notes())
    return a.withColumns({
        "decision_rationale": F.concat_ws("; ", F.concat(F.lit("rule "), "rule"), F.concat_ws(", ", "decision_notes")),
        "remediation_status": F.lit("recommended")}).drop(
        "d", "role_family", "firmware", "t_primary", "t_hybrid",
        "t_alternative", "t_citations")


def decision_summary(assets: DataFrame) -> DataFrame:
    """Assets per outcome, zero-filled, with the count blocked on a role."""
    dim = dimension(assets.sparkSession, [(d, i) for i, d in enumerate(pol.DECISIONS)], ("migration_decision", "rank"))
    n = assets.groupBy("migration_decision").agg(
        F.count(F.lit(1)).alias("n"), F.count("decision_blocked_on").alias("n_blocked"))
    return dim.join(n, "migration_decision", "left").select(
        "migration_decision", "rank", F.coalesce("n", F.lit(0)).alias("assets"),
        F.coalesce("n_blocked", F.lit(0)).alias("blocked"))


def strategy_summary(assets: DataFrame) -> DataFrame:
    return (assets.where("recommended_strategy IS NOT NULL").groupBy("recommended_strategy")
            .agg(F.count(F.lit(1)).alias("assets"))
            .orderBy(F.desc("assets"), "recommended_strategy"))
