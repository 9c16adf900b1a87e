"""Derive a text corpus from the line items: one small file per row, every row used.

Texts are SQL expressions both engines accept; lines are joined with ``chr(10)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..knowledge import algorithms as kb
from ..knowledge.tables import dimension
from .driver_tables import CLS, table

ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"


def lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


def pick(expr: str, values: list[str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PYTHON = lines(
    "'import os'", "'import hashlib'",
    "'from cryptography.hazmat.primitives.asymmetric import rsa, ec'",
    "'from cryptography.hazmat.primitives.ciphers import algorithms'",
    "'SIZE = ' || (1024 * (1 + p_size % 4))", "'k = os.urandom(' || (16 + 8 * (p_size % 3)) || ')'",
    "'key = rsa.generate_private_key(public_exponent=65537, key_size=SIZE)'",
    pick("(l_orderkey % 3)", ["key.sign(data)", "key.decrypt(data)", "pass"]),
    "'c = algorithms.AES(k)'", "'h = hashlib.md5(data)'")
JAVA = lines(
    "'Cipher c = Cipher.getInstance(\"' || kb_name || '\");'",
    pick("(l_orderkey % 2)", ["// checksum of the block", ""]),
    "'String s = \"' || kb_id || '\";'",
    "'MessageDigest.getInstance(\"SHA-256\"); key_size = ' || (p_size * 64) || ';'")
DOC = lines("'# ' || kb_name || ' overview'", "'HMAC-SHA256 and ML-DSA-65 next to ' || kb_id", "'plain words only'")
NGINX = lines(
    "'ssl_protocols ' || " + pick("(l_orderkey % 4)", ["TLSv1 TLSv1.1", "TLSv1.2 TLSv1.3", "SSLv3 TLSv1.2", "TLSv1.3"]) + " || ';'",
    "'ssl_ciphers ECDHE-RSA-AES256-GCM-SHA384:' || " + pick("(p_size % 3)", ["DES-CBC3-SHA", "ECDHE-ECDSA-CHACHA20-POLY1305", "RC4-MD5"]) + " || ';'",
    "'ssl_ecdh_curve ' || " + pick("(p_size % 4)", ["X25519MLKEM768:X25519", "prime256v1:ecdhe", "sntrup761x25519-sha512,x448", "ml-kem-768:secp384r1"]) + " || ';'",
    "'ssl_certificate_key /etc/pki/' || l_partkey || '.key;'")
REQUIREMENTS = lines("'cryptography==' || p_size || '.0'", "'requests>=2'", "'PyNaCl'")
PACKAGE_JSON = "'{\"dependencies\": {\"node-forge\": \"^' || p_size || '.1.0\"}, \"devDependencies\": {\"jsrsasign\": \"~' || p_size || '\"}}'"
POM = "'<dependency><groupId>org.bouncycastle</groupId><artifactId>bcprov-jdk18on</artifactId><version>1.' || p_size || '</version></dependency>'"
GRADLE = "'implementation \"org.openssl:libssl3:3.' || (p_size % 8) || '\"'"
GO_MOD = lines("'module m'", "'require golang.org/x/crypto v0.' || p_size || '.0'")
MANIFEST = "CASE l_partkey % 5 WHEN 0 THEN " + REQUIREMENTS + " WHEN 1 THEN " + PACKAGE_JSON + " WHEN 2 THEN " + POM + " WHEN 3 THEN " + GRADLE + " ELSE " + GO_MOD + " END"
MANIFEST_NAME = pick("(l_partkey % 5)", ["requirements.txt", "package.json", "pom.xml", "build.gradle", "go.mod"])
DOCKER = lines(
    "'FROM ' || " + pick("(p_size % 3)", ["python:3.11", "nginx", "registry.io/lib/alpine:3"]),
    "'RUN apt-get install -y libssl1.1=1.1.' || (p_size % 10) || ' curl && pip install paramiko==2.' || (p_size % 5)",
    "'COPY a' || l_partkey || '.key /etc/ssl/'", "'ENV TLS_MIN=1.' || (p_size % 4)")
PEM = lines(
    "'-----BEGIN ' || " + pick("(p_size % 3)", ["RSA PRIVATE KEY", "CERTIFICATE", "CERTIFICATE REQUEST"]) + " || '-----'",
    "'AAAA'", "'-----END ' || " + pick("(p_size % 3)", ["RSA PRIVATE KEY", "CERTIFICATE", "CERTIFICATE REQUEST"]) + " || '-----'")

FILE_SQL = {
    "path": f"'repo-' || l_suppkey || CASE {CLS} WHEN 0 THEN '/src/' || {ID} || '.py' WHEN 1 THEN '/src/' || {ID} || '.java' "
            f"WHEN 2 THEN '/docs/' || {ID} || '.md' WHEN 3 THEN '/conf/nginx-' || {ID} || '.conf' "
            f"WHEN 4 THEN '/' || {ID} || '/' || {MANIFEST_NAME} WHEN 5 THEN '/' || {ID} || '/Dockerfile' ELSE '/keys/' || {ID} || '.pem' END",
    "text": f"CASE {CLS} WHEN 0 THEN {PYTHON} WHEN 1 THEN {JAVA} WHEN 2 THEN {DOC} WHEN 3 THEN {NGINX} WHEN 4 THEN {MANIFEST} WHEN 5 THEN {DOCKER} ELSE {PEM} END",
}


FILE_KEYS = ("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text); rows that agree in all key columns are one file.

    The keys are made distinct, not the texts: all of them stand in the path, so a file's
    path is its own. Only files without a path and those of a part with several sizes are
    compared as they are. Keys are few bytes and a file much work, so tasks are not merged.
    """
    lines = table(spark, sf_dir, "lineitem").select(*FILE_KEYS)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").where("p_partkey IS NOT NULL").distinct()
    parts = parts.join(parts.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("sizes")), "p_partkey")
    algorithms = dimension(spark, kb.kb_rows(), kb.KB_COLUMNS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(algorithms, F.expr("l_partkey % 48 = kb_ord"))
    named = F.expr(" AND ".join(f"{k} IS NOT NULL" for k in FILE_KEYS))
    own = named & (F.col("sizes") == 1)
    rows = rows.select(*[F.when(named, F.col(k)).alias(k) for k in FILE_KEYS], F.when(~own, F.expr(FILE_SQL["text"])).alias("as_is"),
                       *[F.when(own, F.col(c)).alias(c) for c in ("p_size", "kb_id", "kb_name")])
    rows = rows.repartition(tasks, *FILE_KEYS).distinct()
    return rows.select(F.expr(FILE_SQL["path"]).alias("path"), F.coalesce("as_is", F.expr(FILE_SQL["text"])).alias("text"))


LINKAGE_SQL = {"file": "'bin/' || p_partkey || '.so'", "fmt": "'ELF'", "ord": "CAST(p_size AS BIGINT)",
               "soname": pick("(p_partkey % 6)", ["libssl.so.3", "libcrypto.so.1.1", "libgnutls.so.30", "libm.so.6", "libwolfssl.so", "libtls.so.2"]),
               "openssl_version": "'3.' || (p_size % 7) || '.0'"}
SYMBOL_SQL = {"file": "'bin/' || p_partkey || '.so'", "fmt": "'ELF'", "ord": "CAST(p_size AS BIGINT)",
              "symbol": pick("(p_partkey % 8)", ["EVP_aes_256_gcm", "EVP_aes_128_cbc", "RSA_sign", "SHA256_Init", "EVP_md5", "ML_KEM_768_keygen", "strlen", "HMAC_Update"])}
STRING_SQL = {"file": "'bin/' || p_partkey || '.bin'", "fmt": "'ELF'",
              "body": "p_name || chr(1) || " + pick("(p_partkey % 5)", ["TLSv1.2 and TLSv1.3", "SSLv3_method", "OpenSSL 1.1.1k", "TLSv1_client TLSv1", "nothing here"]) + " || chr(2) || p_type"}
