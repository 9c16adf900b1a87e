"""Parsed-certificate table to detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case, lookup
from ..functions.strength import curve_bits
from ..knowledge import algorithms as kb
from ..sources.schemas import DETECTOR_RANK, conform

# Signature OID -> digest id, public-key id, label.
SIGNATURE_OIDS = {
    "1.2.840.113549.1.1.4": ("md5", "rsa", "md5WithRSAEncryption"),
    "1.2.840.113549.1.1.5": ("sha-1", "rsa", "sha1WithRSAEncryption"),
    "1.2.840.113549.1.1.11": ("sha-256", "rsa", "sha256WithRSAEncryption"),
    "1.2.840.113549.1.1.12": ("sha-384", "rsa", "sha384WithRSAEncryption"),
    "1.2.840.113549.1.1.13": ("sha-512", "rsa", "sha512WithRSAEncryption"),
    "1.2.840.113549.1.1.14": ("sha-224", "rsa", "sha224WithRSAEncryption"),
    "1.2.840.113549.1.1.10": (None, "rsa", "RSASSA-PSS"),
    "1.2.840.10040.4.3": ("sha-1", "dsa", "dsa-with-sha1"),
    "2.16.840.1.101.3.4.3.2": ("sha-256", "dsa", "dsa-with-sha256"),
    "1.2.840.10045.4.1": ("sha-1", "ecdsa", "ecdsa-with-SHA1"),
    "1.2.840.10045.4.3.1": ("sha-224", "ecdsa", "ecdsa-with-SHA224"),
    "1.2.840.10045.4.3.2": ("sha-256", "ecdsa", "ecdsa-with-SHA256"),
    "1.2.840.10045.4.3.3": ("sha-384", "ecdsa", "ecdsa-with-SHA384"),
    "1.2.840.10045.4.3.4": ("sha-512", "ecdsa", "ecdsa-with-SHA512"),
    "1.3.101.112": (None, "ed25519", "Ed25519"),
    "1.3.101.113": (None, "ed448", "Ed448"),
    "2.16.840.1.101.3.4.3.17": (None, "ml-dsa-44", "ML-DSA-44"),
    "2.16.840.1.101.3.4.3.18": (None, "ml-dsa-65", "ML-DSA-65"),
    "2.16.840.1.101.3.4.3.19": (None, "ml-dsa-87", "ML-DSA-87"),
    "2.16.840.1.101.3.4.3.20": (None, "slh-dsa-sha2-128s", "SLH-DSA-SHA2-128s"),
}

# Public-key OID -> algorithm id.
PUBLIC_KEY_OIDS = {
    "1.2.840.113549.1.1.1": "rsa", "1.2.840.10040.4.1": "dsa",
    "1.2.840.10045.2.1": "ecdsa", "1.3.101.112": "ed25519", "1.3.101.113": "ed448",
    "1.3.101.110": "x25519", "1.3.101.111": "x448", "1.2.840.113549.1.3.1": "dh",
    "2.16.840.1.101.3.4.4.1": "ml-kem-512", "2.16.840.1.101.3.4.4.2": "ml-kem-768",
    "2.16.840.1.101.3.4.4.3": "ml-kem-1024",
}

EC_KEY_BITS = {128: 256, 192: 384, 256: 521, 112: 224, 96: 192}
AGREEMENT = tuple(a[0] for a in kb.ALGORITHMS if a[3] in ("key-agree", "kem"))


def days_to_expiry(not_after: Column, as_of: Column) -> Column:
    """Whole days left, floored, so an hour past expiry is day -1."""
    return F.floor((F.unix_timestamp(not_after) - F.unix_timestamp(as_of)) / 86400).cast("int")


def resolve_oids(certificates: DataFrame) -> DataFrame:
    """Fill algorithm columns from OIDs and the EC key size from its curve."""
    sig = {k: v for k, v in SIGNATURE_OIDS.items()}
    c = certificates
    have = set(c.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    c = (c.withColumn("sig_hash", F.coalesce(col("sig_hash"), lookup(col("sig_oid"), {k: v[0] for k, v in sig.items() if v[0]})))
         .withColumn("sig_algorithm", F.coalesce(col("sig_algorithm"), lookup(col("sig_oid"), {k: v[1] for k, v in sig.items()})))
         .withColumn("sig_algorithm_label", F.coalesce(col("sig_algorithm_label"), lookup(col("sig_oid"), {k: v[2] for k, v in sig.items()})))
         .withColumn("pubkey_algorithm", F.coalesce(col("pubkey_algorithm"), lookup(col("pubkey_oid"), PUBLIC_KEY_OIDS))))
    size = col("key_size").cast("int")
    return c.withColumn("key_size", F.coalesce(size, case(
        (F.col("pubkey_algorithm").isin("ed25519", "x25519"), F.lit(256)),
        (F.col("pubkey_algorithm").isin("ed448", "x448"), F.lit(448)),
        (F.col("pubkey_algorithm") == "ecdsa", lookup(curve_bits(col("curve")), EC_KEY_BITS)))))


def certificate_detections(certificates: DataFrame, as_of: Column, *keep: str) -> DataFrame:
    """Two rows per certificate: its subject key and the digest that signs it. ``keep``
    names further columns of a certificate that both rows carry."""
    c = resolve_oids(certificates)
    usage = lambda u: F.coalesce(F.array_contains("key_usage", u), F.lit(False))
    key_role = case(
        (F.col("pubkey_algorithm").isin(*AGREEMENT), kb.KE),
        (F.coalesce("is_ca", F.lit(False)) | usage("keyCertSign"), kb.CERTVAL),
        (usage("keyEncipherment") | usage("dataEncipherment"), kb.KT),
        (usage("keyAgreement"), kb.KE), otherwise=kb.SIG)
    struct = F.struct(
        "subject", "issuer", "serial", "not_before", "not_after", "self_signed", "san",
        "sig_algorithm_label", "is_ca",
        days_to_expiry(F.col("not_after"), as_of).alias("days_to_expiry"))
    none = F.lit(None)
    key = F.struct(
        F.lit(0).cast("bigint").alias("sub"), F.col("pubkey_algorithm").alias("algorithm"),
        key_role.alias("role"), F.col("key_size").alias("key_size"), F.col("curve").alias("curve"),
        F.concat("pubkey_algorithm", F.lit(" subject public key")).alias("matched"),
        F.lit("x509-subjectPublicKeyInfo").alias("api_call"),
        F.lit("subject-public-key").alias("cert_component"), F.col("pubkey_oid").alias("oid"))
    signed = F.coalesce("sig_hash", "sig_algorithm")
    digest = F.struct(
        F.lit(1).cast("bigint").alias("sub"), signed.alias("algorithm"),
        F.lit(kb.VER).alias("role"), none.cast("int").alias("key_size"),
        none.cast("string").alias("curve"),
        F.coalesce("sig_algorithm_label", signed).alias("matched"),
        F.lit("x509-signatureAlgorithm").alias("api_call"),
        F.lit("signature-algorithm").alias("cert_component"), F.col("sig_oid").alias("oid"))
    rows = c.select(
        "file", F.col("serial").alias("serial_key"), struct.alias("certificate"), *keep,
        F.explode(F.array(key, digest)).alias("d")).where("d.algorithm IS NOT NULL")
    return conform(rows.select(
        "file", F.lit(DETECTOR_RANK["certificate-x509"]).alias("det_rank"),
        F.lit(0).alias("ord"), "d.*", F.lit("certificate-x509").alias("detector"),
        F.lit("x509-parse").alias("method"), F.lit("high").alias("confidence"),
        F.lit("x509").alias("language"), "certificate",
        F.lit("parsed certificate field; role derived from key usage").alias("reasoning"), *keep), *keep)
