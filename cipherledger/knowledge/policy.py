"""Policies, migration targets, scales and rule vocabularies."""

from __future__ import annotations

# Id, name, symmetric floor, hash floor, public-key floor, year by which
# quantum-vulnerable public keys must be gone, standalone post-quantum allowed.
POLICIES = [
    ("nist_general", "NIST general purpose", 128, 128, 112, 2035, True),
    ("nsa_cnsa2", "NSA CNSA 2.0 (national security systems)", 256, 384, 192, 2033, True),
    ("high_assurance_hybrid", "High-assurance PQ/T hybrid first", 256, 256, 128, 2030, False),
]
POLICY_COLUMNS = ("policy_id", "policy_name", "min_symmetric", "min_hash",
                  "min_classical_pk", "require_pqc_by", "allow_non_hybrid")
DEFAULT_POLICY = "nist_general"

# Role family, strength tier, primary, hybrid, alternative, citations.
TARGETS = [
    ("key-establishment", 128, "ML-KEM-768", "X25519MLKEM768", "HQC", "FIPS203 RFC10024 RFC9954"),
    ("key-establishment", 192, "ML-KEM-768", "SecP384r1MLKEM1024", "ML-KEM-1024", "FIPS203 RFC10024"),
    ("key-establishment", 256, "ML-KEM-1024", "SecP384r1MLKEM1024", None, "FIPS203 NSA_CNSA2 RFC10024"),
    ("signature", 128, "ML-DSA-65", None, "SLH-DSA-SHA2-128s", "FIPS204 FIPS205"),
    ("signature", 192, "ML-DSA-65", None, "SLH-DSA-SHA2-192s", "FIPS204 FIPS205"),
    ("signature", 256, "ML-DSA-87", None, "SLH-DSA-SHA2-192s", "FIPS204 NSA_CNSA2"),
    ("firmware-signature", 128, "SLH-DSA-SHA2-128s", None, "LMS", "FIPS205 SP800208"),
    ("firmware-signature", 192, "SLH-DSA-SHA2-128s", None, "LMS", "FIPS205 SP800208"),
    ("firmware-signature", 256, "SLH-DSA-SHA2-128s", None, "LMS", "FIPS205 SP800208"),
]
TARGET_COLUMNS = ("t_family", "t_tier", "t_primary", "t_hybrid", "t_alternative", "t_citations")

FIRMWARE_WORDS = ("firmware", "bootloader", "secureboot", "secure_boot",
                  "code-sign", "codesign", "image-signing", "uefi")

# Ordered scales and their scores.
CLASSIFICATION = {"public": 1, "internal": 2, "confidential": 3, "sensitive": 4, "mission-critical": 5}
EXPOSURE = {"isolated": 0, "internal": 1, "controlled": 2, "external-facing": 3, "internet-facing-critical": 4}
CRITICALITY = {"non-critical": 1, "low": 2, "important": 3, "high": 4, "mission-critical": 5}
EFFORT = {"trivial": 1, "low": 2, "moderate": 3, "high": 4, "very-high": 5}
EFFORT_MONTHS = {"trivial": 3, "low": 6, "moderate": 12, "high": 24, "very-high": 36}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.72, "low": 0.42}
CONFIDENCE_DAMPING = {"high": 1.0, "medium": 0.92, "low": 0.78}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
REMEDIATION = ("detected", "recommended", "accepted", "in-progress", "migrated", "verified")
BANDS = ("critical", "high", "medium", "low", "info")
DECISIONS = ("RETAIN", "HARDEN", "UPGRADE", "HYBRID", "PQC-ONLY")
URGENCIES = ("already-late", "critical", "urgent", "plan-now", "monitor", "not-applicable")
URGENCY_MULTIPLIER = {"already-late": 1.30, "critical": 1.20, "urgent": 1.05,
                      "plan-now": 0.90, "monitor": 0.72, "not-applicable": 1.00}
PRIORITY_BANDS = ("P0", "P1", "P2", "P3")

# Factor weights of the composite score.
WEIGHTS = {"algorithm_exposure": 0.30, "data_lifetime": 0.20, "data_sensitivity": 0.18,
           "exposure": 0.14, "business_criticality": 0.12, "migration_effort": 0.06}

# Detector method -> evidence type.
METHOD_EVIDENCE = {
    "ast-call": "source-api", "regex+context": "source-lexical", "regex": "source-lexical",
    "config-directive": "config-directive", "config-cipher-suite": "config-directive",
    "x509-parse": "certificate", "pem-scan": "key-material", "manifest": "manifest",
    "dynamic-linkage": "binary-linkage", "symbol-table": "binary-symbol",
    "strings": "binary-string", "base-image": "container-package",
    "os-package": "container-package", "lang-package": "container-package",
    "image-file": "container-package", "env-config": "config-directive",
}

# Strategy -> decision before contextual overrides.
STRATEGY_DECISION = {
    "retain": "RETAIN", "strengthen-parameters": "HARDEN", "replace-now-classical": "UPGRADE",
    "upgrade-protocol": "UPGRADE", "renew-certificate": "HARDEN",
    "rotate-and-externalise-key": "HARDEN", "re-pin-to-standard": "HYBRID",
    "migrate-to-pqt-hybrid": "HYBRID", "migrate-to-pqc": "PQC-ONLY",
    "determine-role-then-migrate": "HARDEN", "verify-manually": "HARDEN",
}

# Programme phases.
PHASES = [
    ("PH0", "Phase 0 -- Discover", "Complete (this scan)"),
    ("PH1", "Phase 1 -- Classify & Validate", "2-6 weeks"),
    ("PH2", "Phase 2 -- Fix What Is Broken Today", "1-3 months"),
    ("PH3", "Phase 3 -- Crypto-Agility Enablement", "3-9 months (parallel with Phase 2)"),
    ("PH4", "Phase 4 -- Pilot PQ/T Hybrid", "3-6 months"),
    ("PH5", "Phase 5 -- Staged Migration", "12-36 months"),
    ("PH6", "Phase 6 -- Retire Quantum-Vulnerable Cryptography", "Aligned to the 2035 policy deadline"),
]

# Default planning horizons for a scenario sweep.
CRQC_YEARS = (2030, 2035, 2040, 2045, 2050)
DEFAULT_CRQC_YEAR = 2035
