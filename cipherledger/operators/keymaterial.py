"""PEM blocks and key containers: presence only, never bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case, extension
from ..sources.schemas import DETECTOR_RANK, conform
from .facts import fact, facts_of

PEM_BLOCK = r"(?s)-----BEGIN ([A-Z0-9 ]+)-----\r?\n(.*?)-----END \1-----"
CERTIFICATE_LABELS = ("CERTIFICATE", "X509 CERTIFICATE", "TRUSTED CERTIFICATE")


def block_class(label: Column) -> Column:
    return case((F.contains(label, F.lit("PRIVATE KEY")), "private-key"),
                (F.contains(label, F.lit("CERTIFICATE REQUEST")), "signing-request"),
                (label.isin(*CERTIFICATE_LABELS), "certificate"), otherwise="other")


def pem_blocks(files: DataFrame) -> DataFrame:
    """(path, pos, label, class) of every PEM block; the text is dropped here."""
    labels = F.regexp_extract_all("text", F.lit(PEM_BLOCK), F.lit(1))
    return (files.where(F.contains("text", F.lit("-----BEGIN "))).select("path", F.posexplode(labels).alias("pos", "label"))
            .withColumn("class", block_class(F.col("label"))))


#: A certificate or a private key in text form; other blocks, such as requests, are text.
PARSED = r"-----BEGIN (X509 |TRUSTED )?CERTIFICATE-----|-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"


def key_facts(text: Column) -> Column:
    """One fact for a file that holds a private key."""
    labels = F.regexp_extract_all(text, F.lit(PEM_BLOCK), F.lit(1))
    some = F.contains(text, F.lit("-----BEGIN ")) & F.exists(labels, lambda label: block_class(label) == "private-key")
    return F.when(some, F.array(fact("private-key")))


def certificate_facts(text: Column) -> Column:
    """One fact for every certificate block; certificates are parsed by ordinary tools."""
    labels = F.filter(F.regexp_extract_all(text, F.lit(PEM_BLOCK), F.lit(1)), lambda label: block_class(label) == "certificate")
    return F.when(F.contains(text, F.lit("-----BEGIN ")), F.transform(labels, lambda label, i: fact("certificate", pos=i, a=label)))


def container_facts() -> Column:
    """One fact for a password-protected container, found by its name alone."""
    return F.when(extension(F.col("path")).isin(".p12", ".pfx"), F.array(fact("key-container")))


def refine(facts: DataFrame) -> DataFrame:
    """Private keys and containers: presence and location, recorded as metadata."""
    key = F.col("fact") == "private-key"
    return conform(facts.where(F.col("fact").isin("private-key", "key-container")).select(
        F.col("path").alias("file"), F.lit(DETECTOR_RANK["certificate-x509"]).alias("det_rank"),
        F.when(key, 10**6).otherwise(2 * 10**6).alias("ord"), F.lit(0).alias("sub"), F.lit("certificate-x509").alias("detector"),
        F.when(key, "pem-scan").otherwise("container-scan").alias("method"), F.when(key, "high").otherwise("medium").alias("confidence"),
        F.when(key, "pem").otherwise("pkcs12").alias("language"),
        F.when(key, "private key material").otherwise("password-protected key container").alias("matched"),
        F.when(key, "presence and location only").otherwise("content is not opened").alias("reasoning"),
        F.when(key, "private-key-detection").otherwise("key-container").alias("api_call"), F.lit(True).alias("key_material_in_repo")))


def key_detections(files: DataFrame) -> DataFrame:
    """One detection per file that holds a private key."""
    return refine(facts_of(files, key_facts))
