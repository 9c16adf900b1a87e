"""Crypto-agility (how hard is a change) and interoperability (may we change alone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case
from ..knowledge import algorithms as kb
from .risk import OLD_TLS, tagged


def signals() -> list[tuple[Column, float, str]]:
    c = F.col
    kind, proto, ver = c("asset_type"), c("protocol"), c("protocol_version")
    ready, lang = c("pqc_readiness"), c("language")
    return [
        (kind == "binary-artifact", 2.5, "compiled-into-binary"),
        (kind == "protocol-config", -2.0, "configuration-directive"),
        (kind == "certificate", 1.0, "changes-at-reissuance"),
        (kind.isin("dependency", "container-package"), -0.5, "packaged-dependency"),
        (kind == "source-finding", 0.5, "source-call-site"),
        ((kind == "source-finding") & (c("evidence_type") == "source-api"), 0.5, "literal-at-call-site"),
        ((proto == "TLS") & (ver == "1.3"), -1.5, "tls13-negotiates-groups"),
        ((proto == "TLS") & ver.isin(*OLD_TLS), 1.0, "tls-version-lacks-hybrid-groups"),
        (proto.isin("SSH", "IKE"), -1.0, "session-negotiation"),
        (ready == "native", -1.5, "provider-native"),
        (ready == "provider", 0.5, "provider-upgrade-needed"),
        (ready == "none", 2.0, "provider-has-no-path"),
        (tagged("crypto-agility-blocker"), 1.5, "agility-blocker"),
        (tagged("key-material-exposure"), 1.0, "embedded-key-material"),
        (lang.isin("c", "cpp"), 0.75, "native-code"),
        (lang.isin("java", "kotlin", "scala"), 0.25, "jvm-platform"),
        (lang == "config", -1.0, "declarative-configuration"),
    ]


def agility_points() -> Column:
    total = F.lit(0.0)
    for cond, weight, _ in signals():
        total = total + F.when(cond, weight).otherwise(0.0)
    return total


def agility_of(points: Column) -> Column:
    return case((points <= -1.5, "high"), (points <= 1.5, "medium"), otherwise="low")


def signal_list() -> Column:
    """The signals behind the verdict, with their weights."""
    return F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(weight).alias("weight"), F.lit(name).alias("signal")))
        for cond, weight, name in signals()]))


def interoperability() -> Column:
    """struct(level, reason)"""
    def out(level, reason):
        return F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))

    c = F.col
    return case(
        (c("asset_type") == "certificate", out("constrained", "certificate-authority-and-relying-parties")),
        (c("cryptographic_role") == kb.CERTVAL, out("constrained", "validates-foreign-certificates")),
        (c("asset_type") == "binary-artifact", out("constrained", "vendor-build")),
        (c("protocol").isin("TLS", "SSH", "IKE") & c("internet_exposed"), out("negotiated", "internet-peers")),
        (c("protocol").isin("TLS", "SSH", "IKE"), out("negotiated", "internal-peers")),
        (c("internet_exposed"), out("negotiated", "external-clients")),
        (c("cryptographic_role") == kb.VER, out("negotiated", "verifies-foreign-signatures")),
        otherwise=out("open", "both-ends-controlled"))


def assess_agility(assets: DataFrame) -> DataFrame:
    have = assets.columns
    agility = agility_of(F.col("agility_points"))
    level = F.col("interop.level")
    if "agility_override" in have:
        agility = F.coalesce("agility_override", agility)
    if "interoperability_override" in have:
        level = F.coalesce("interoperability_override", level)
    return assets.withColumns({
        "agility_points": agility_points(), "crypto_agility_signals": signal_list(),
        "interop": interoperability()}).withColumns({
        "crypto_agility": agility, "interoperability": level,
        "interoperability_reason": F.col("interop.reason")}).drop("interop")
