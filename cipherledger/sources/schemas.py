"""Table schemas shared by detectors and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CERTIFICATE = (
    "struct<subject:string, issuer:string, serial:string, not_before:timestamp, "
    "not_after:timestamp, self_signed:boolean, san:array<string>, "
    "sig_algorithm_label:string, is_ca:boolean, days_to_expiry:int>")

# file, det_rank, ord, sub and line form the total order of detections.
DETECTION = {
    "file": "string", "det_rank": "int", "ord": "bigint", "sub": "bigint", "line": "int",
    "detector": "string", "method": "string", "confidence": "string",
    "algorithm": "string", "role": "string", "key_size": "int", "curve": "string",
    "mode": "string", "padding": "string", "protocol": "string",
    "protocol_version": "string", "library": "string", "library_version": "string",
    "package": "string", "language": "string", "snippet": "string", "matched": "string",
    "reasoning": "string", "api_call": "string", "in_test_path": "boolean",
    "suspected_non_security_use": "boolean", "key_size_assumed": "boolean",
    "key_material_in_repo": "boolean", "key_material_in_image": "boolean",
    "crypto_agility_blocker": "boolean", "floating_tag": "boolean",
    "hybrid_non_nist": "boolean", "pqc_capability": "string", "pqc_note": "string",
    "weak_suite_tokens": "array<string>", "evidence_tier": "string",
    "cert_component": "string", "image": "string", "container": "string",
    "oid": "string", "certificate": CERTIFICATE,
}

# Order in which detectors report on one file.
DETECTOR_RANK = {"certificate-x509": 0, "binary-format": 1, "python-ast": 2,
                 "config-semantic": 3, "dependency-manifest": 4, "container": 5,
                 "lexical-context": 6}


def conform(df: DataFrame, *keep: str) -> DataFrame:
    """Project any detector output to the detection schema, filling missing columns, and
    ``keep`` further ones."""
    have = set(df.columns)
    return df.select(*[
        (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
        for name, kind in DETECTION.items()], *keep)
