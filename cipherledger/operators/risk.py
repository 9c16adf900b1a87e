"""Independent classical and quantum axes, effort and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case, lookup, round_tenth
from ..functions.strength import classical_status
from ..knowledge import algorithms as kb
from ..knowledge import policy as pol
from ..knowledge.tables import dimension

CIPHERS = ("block-cipher", "stream-cipher", "ae")
OLD_TLS = ("1.0", "1.1", "1.2")


def with_policy(assets: DataFrame, policy: str = pol.DEFAULT_POLICY) -> DataFrame:
    """Attach one policy profile; an unknown id means the default one."""
    rows = [p for p in pol.POLICIES if p[0] == policy] or [
        p for p in pol.POLICIES if p[0] == pol.DEFAULT_POLICY]
    values = dict(zip(pol.POLICY_COLUMNS, rows[0]))
    return assets.withColumns({k: F.lit(v) for k, v in values.items()})


def for_each_policy(assets: DataFrame) -> DataFrame:
    """Every asset under every profile (three fixed rows, broadcast)."""
    dim = dimension(assets.sparkSession, pol.POLICIES, pol.POLICY_COLUMNS)
    return assets.crossJoin(dim)


def tagged(tag: str) -> Column:
    return F.array_contains("tags", tag)


def _version() -> Column:
    return F.trim(F.coalesce("protocol_version", F.lit("")))


def known() -> Column:
    return F.col("algorithm_label").isNotNull()


def classical_axis() -> Column:
    """struct(band, trigger): exposure to cryptanalysis available today."""
    def out(band, trigger):
        band = band if isinstance(band, Column) else F.lit(band)
        return F.struct(band.alias("band"), F.lit(trigger).alias("trigger"))

    c, ver, proto = F.col, _version(), F.upper("protocol")
    bits = c("security_strength")
    floor = policy_floor()
    by_bits = case((bits < 80, "critical"), (bits < 112, "high"), (bits < 128, "medium"),
                   (bits < 192, "low"), otherwise="info")
    band = F.when((bits < floor) & by_bits.isin("info", "low"), "medium").otherwise(by_bits)
    only_protocol = ~known() & F.coalesce(c("protocol") != "", F.lit(False))
    return case(
        (c("days_to_expiry") < 0, out("critical", "expired-certificate")),
        (c("days_to_expiry") < 30, out("high", "expiring-certificate")),
        (F.contains(F.lower("certificate_sig_algorithm"), F.lit("sha1")), out("critical", "sha1-signature")),
        (tagged("weak-cipher-suite"), out("high", "weak-cipher-suite")),
        (only_protocol & ((proto == "SSL") | ver.isin("2.0", "3.0")), out("critical", "prohibited-protocol")),
        (only_protocol & ver.isin("1.0", "1.1"), out("high", "deprecated-protocol")),
        (only_protocol & (ver == "1.2"), out("low", "current-protocol")),
        (only_protocol & (ver == "1.3"), out("info", "current-protocol")),
        (only_protocol, out("low", "protocol-unreviewed")),
        (~known(), out("info", "unresolved")),
        (c("algorithm_status") == "broken", out("critical", "broken-primitive")),
        (c("quantum_class") == kb.BROKEN, out("high", "deprecated-primitive")),
        (bits.isNotNull(), out(band, "parameter-strength")),
        otherwise=out("low", "indeterminate"))


def policy_floor() -> Column:
    p = F.col("primitive")
    return case((p.isin("hash", "mac"), F.col("min_hash")),
                (p.isin(*CIPHERS), F.col("min_symmetric")),
                otherwise=F.col("min_classical_pk"))


def quantum_axis() -> Column:
    """struct(band, trigger, harvest_now): exposure to a large quantum computer. Reads
    nothing the classical axis produces."""
    def out(band, trigger, harvest=None):
        return F.struct(F.lit(band).alias("band"), F.lit(trigger).alias("trigger"),
                        (harvest if isinstance(harvest, Column) else F.lit(harvest))
                        .cast("boolean").alias("harvest_now"))

    c, q = F.col, F.col("quantum_class")
    role = c("cryptographic_role")
    harvest = case(
        (role.isin(kb.KE, kb.KT) & (F.coalesce("data_lifetime_years", F.lit(0)) >= 5), F.lit(True)),
        (role.isin(kb.SIG, kb.VER, kb.AUTH, kb.CERTVAL), F.lit(False)))
    tls = c("protocol") == "TLS"
    strong_hash = F.coalesce("security_strength", F.lit(0)) >= c("min_hash")
    return case(
        (~known() & tls & c("protocol_version").isin(*OLD_TLS), out("medium", "protocol-blocks-pqc")),
        (~known() & tls & (c("protocol_version") == "1.3"), out("low", "protocol-pqc-capable")),
        (~known(), out("info", "unresolved")),
        (q == kb.SHOR, out("critical", "shor-vulnerable", harvest)),
        ((q == kb.GROVER) & (c("primitive") == "hash") & strong_hash, out("info", "grover-hash")),
        ((q == kb.GROVER) & (c("primitive") == "hash"), out("low", "grover-hash")),
        ((q == kb.GROVER) & (c("quantum_strength") < 96), out("medium", "grover-margin-low")),
        (q == kb.GROVER, out("info", "grover-adequate")),
        (q == kb.BROKEN, out("info", "classical-not-quantum")),
        (q == kb.PQC, out("info", "already-migrated")),
        (q == kb.SELECTED, out("low", "pqc-not-final")),
        ((q == kb.HYBRID) & (c("algorithm_status") == "deprecated"), out("medium", "draft-hybrid")),
        (q == kb.HYBRID, out("info", "hybrid-target-state")),
        otherwise=out("low", "indeterminate"))


def exposure_factor() -> Column:
    """0-100 exposure of the primitive or protocol itself."""
    c, q, ver = F.col, F.col("quantum_class"), _version()
    proto = F.upper(F.coalesce("protocol", F.lit("")))
    bare = ~known()
    return case(
        (bare & ~F.coalesce(c("protocol") != "", F.lit(False)), 25.0),
        (bare & ((proto == "SSL") | ver.isin("2.0", "3.0")), 95.0),
        (bare & ver.isin("1.0", "1.1"), 82.0),
        (bare & (ver == "1.2"), 55.0), (bare & (ver == "1.3"), 18.0), (bare, 40.0),
        (q == kb.SHOR, 100.0),
        ((q == kb.BROKEN) & (c("algorithm_status") == "broken"), 95.0), (q == kb.BROKEN, 80.0),
        ((q == kb.GROVER) & (c("security_strength") < 112), 70.0),
        ((q == kb.GROVER) & (c("quantum_strength") < 96), 35.0), (q == kb.GROVER, 10.0),
        (q == kb.PQC, 3.0), (q == kb.SELECTED, 30.0),
        ((q == kb.HYBRID) & (c("algorithm_status") == "deprecated"), 45.0), (q == kb.HYBRID, 2.0),
        otherwise=30.0)


def effort_score() -> Column:
    c = F.col
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return (F.lit(2.0)
            + add(c("asset_type") == "certificate", 1.0)
            + add(c("asset_type") == "binary-artifact", 1.5)
            + add((c("protocol") == "TLS") & c("protocol_version").isin(*OLD_TLS), 1.0)
            + lookup(c("pqc_readiness"), {"none": 1.5, "provider": 0.5, "native": -0.5}, 0.0)
            + add(c("language").isin("java", "kotlin", "scala"), 0.5)
            + add(c("language").isin("c", "cpp"), 0.5)
            + add(tagged("crypto-agility-blocker"), 1.0)
            + add(tagged("key-material-exposure"), 0.5)
            + add(c("business_criticality").isin("mission-critical", "high"), 0.5))


def effort_bucket(score: Column) -> Column:
    return case((score <= 2.0, "trivial"), (score <= 2.8, "low"), (score <= 3.8, "moderate"),
                (score <= 4.8, "high"), otherwise="very-high")


def band_of(score: Column) -> Column:
    return case((score >= 80, "critical"), (score >= 60, "high"), (score >= 40, "medium"),
                (score >= 20, "low"), otherwise="info")


def factor_columns(weights: dict | None = None) -> dict[str, tuple[Column, float]]:
    """Factor name -> (raw 0-100, weight), in the order they are summed."""
    w = weights or pol.WEIGHTS
    score = lambda col, scale, default: lookup(F.coalesce(col, F.lit(default)), scale)
    lifetime = F.coalesce("data_lifetime_years", F.lit(3))
    raw = {
        "algorithm_exposure": F.col("exposure_raw"),
        "data_lifetime": F.least(lifetime, F.lit(20)) / F.lit(20.0) * 100.0,
        "data_sensitivity": (score(F.col("data_classification"), pol.CLASSIFICATION, "internal") - 1) / F.lit(4.0) * 100.0,
        "exposure": score(F.col("exposure"), pol.EXPOSURE, "internal") / F.lit(4.0) * 100.0,
        "business_criticality": (score(F.col("business_criticality"), pol.CRITICALITY, "important") - 1) / F.lit(4.0) * 100.0,
        "migration_effort": (lookup(F.col("assessed_effort"), pol.EFFORT) - 1) / F.lit(4.0) * 100.0,
    }
    return {k: (v, w[k]) for k, v in raw.items()}


def assess(assets: DataFrame, weights: dict | None = None) -> DataFrame:
    """Both axes and the composite score. Needs the policy columns."""
    a = assets.withColumns({
        "classical": classical_axis(), "quantum": quantum_axis(),
        "exposure_raw": exposure_factor(), "effort_points": effort_score()})
    a = a.withColumn("assessed_effort", effort_bucket(F.col("effort_points")))
    factors = factor_columns(weights)
    total = F.lit(0.0)
    for raw, weight in factors.values():
        total = total + raw * F.lit(float(weight))
    damping = lookup(F.col("confidence"), pol.CONFIDENCE_DAMPING)
    score = (total * damping
             * F.when(tagged("suspected-non-security-use"), 0.55).otherwise(1.0)
             * F.when(tagged("test-path"), 0.7).otherwise(1.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    override = F.col("effort_override") if "effort_override" in assets.columns else F.lit(None).cast("string")
    months = F.col("months_override") if "months_override" in assets.columns else F.lit(None).cast("int")
    a = a.withColumns({
        "score_exact": score,
        "risk_factors": F.array(*[
            F.struct(F.lit(n).alias("name"), r.alias("raw"), F.lit(float(w)).alias("weight"),
                     (r * F.lit(float(w))).alias("contribution")) for n, (r, w) in factors.items()]),
        "migration_effort": F.coalesce(override, F.col("assessed_effort"))})
    return a.withColumns({
        "risk_score": round_tenth(F.col("score_exact")),
        "risk_band": band_of(F.col("score_exact")),
        "classical_risk": F.col("classical.band"), "classical_trigger": F.col("classical.trigger"),
        "quantum_exposure": F.col("quantum.band"), "quantum_trigger": F.col("quantum.trigger"),
        "harvest_now": F.col("quantum.harvest_now"),
        "classical_security_status": F.when(known(), classical_status(
            F.col("algorithm_status"), F.col("security_strength"))).otherwise("unknown"),
        "migration_months": F.coalesce(months, lookup(F.col("migration_effort"), pol.EFFORT_MONTHS)),
    }).drop("classical", "quantum", "exposure_raw", "effort_points", "assessed_effort", "score_exact")
