"""Binary evidence: linkage tables, symbol tables and printable strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, lookup
from ..functions.packages import capability, resolve_package, with_library
from ..knowledge import algorithms as kb
from ..knowledge import libraries as lib
from ..sources.schemas import DETECTOR_RANK, conform
from .facts import exploded, fact, together

# Fixed values, in order: symbol pattern -> algorithm.
SYMBOLS = [
    (r"EVP_aes_256_gcm|AES_256_GCM|aes256gcm", "aes-256"),
    (r"EVP_aes_128_gcm|AES_128_GCM", "aes-128"),
    (r"EVP_aes_256_cbc", "aes-256"), (r"EVP_aes_128_cbc", "aes-128"),
    (r"EVP_des_ede3|DES_ede3", "3des"), (r"EVP_rc4|RC4_set_key", "rc4"),
    (r"EVP_chacha20_poly1305", "chacha20-poly1305"),
    (r"EVP_sha256|SHA256_(Init|Update|Final)", "sha-256"), (r"EVP_sha384|SHA384_Init", "sha-384"),
    (r"EVP_sha512|SHA512_Init", "sha-512"), (r"EVP_sha1\b|SHA1_(Init|Update|Final)", "sha-1"),
    (r"EVP_md5\b|MD5_(Init|Update|Final)", "md5"),
    (r"RSA_(generate_key|new|sign|verify|public_encrypt|private_decrypt)|EVP_PKEY_CTX_set_rsa", "rsa"),
    (r"ECDSA_(do_sign|do_verify|sign|verify)|EVP_PKEY_ECDSA", "ecdsa"),
    (r"ECDH_compute_key|EVP_PKEY_derive", "ecdh"), (r"X25519|curve25519", "x25519"),
    (r"ED25519_(sign|verify)|Ed25519", "ed25519"), (r"DH_compute_key|DH_generate_key", "dh"),
    (r"DSA_(do_sign|do_verify)", "dsa"), (r"ML_KEM|mlkem|EVP_PKEY_ML_KEM", "ml-kem-768"),
    (r"ML_DSA|mldsa", "ml-dsa-65"), (r"SLH_DSA|slhdsa|sphincs", "slh-dsa-sha2-128s"),
    (r"PKCS5_PBKDF2_HMAC", "pbkdf2"), (r"HMAC_(Init|Update|Final)", "hmac-sha256"),
]
# Version strings and the markers of a crypto-relevant string.
TLS_STRINGS = [(r"TLSv1\.3", "TLS", "1.3"), (r"TLSv1\.2", "TLS", "1.2"), (r"TLSv1\.1", "TLS", "1.1"),
               (r"TLSv1(?![\.0-9])", "TLS", "1.0"), (r"SSLv3", "SSL", "3.0")]
OPENSSL_VERSION = r"OpenSSL\s+(\d+\.\d+\.\d+[a-z]?)"
PRINTABLE = r"[\x20-\x7e]{6,}"
MARKERS = (r"EVP_|SSL|TLS|AES|RSA|SHA|ECDSA|OpenSSL|libcrypto|MD5|ML-KEM|ML_KEM|ChaCha|X25519|kem")


def _common(kind: str, language: Column) -> dict:
    return {"detector": F.lit("binary-format"), "det_rank": F.lit(DETECTOR_RANK["binary-format"]),
            "method": F.lit(kind), "api_call": F.lit(kind), "language": F.lower(language), "sub": F.lit(0)}


def binary_format(path: Column, content: Column) -> Column:
    """Format by the leading bytes; null for anything that is no executable or library."""
    head = F.hex(F.substring(content, 1, 4))
    return (F.when(head == "7F454C46", "elf").when(head.startswith("4D5A"), "pe")
            .when(head.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE") | ((head == "CAFEBABE") & ~path.endswith(".class")), "macho"))


def resolve_soname(soname: Column) -> Column:
    """Stem as a package, whole name as a package, then a known soname stem inside it."""
    stem = F.substring_index(F.element_at(F.split(soname, "/"), -1), ".", 1)
    known = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(l).alias("l")) for _, s, l in lib.soname_rows()])
    inside = F.try_element_at(F.transform(F.filter(known, lambda r: F.contains(soname, r["s"])), lambda r: r["l"]), F.lit(1))
    return F.coalesce(resolve_package(stem), resolve_package(soname), inside)


def linkage_detections(linkage: DataFrame) -> DataFrame:
    """Rows (file, fmt, ord, soname, openssl_version)."""
    d = with_library(linkage.withColumn("library", resolve_soname(F.col("soname"))).where("library IS NOT NULL"))
    version = F.when(F.col("library") == "openssl", F.col("openssl_version"))
    cap = capability(F.col("lib_pqc"), F.col("lib_since"), version)
    return conform(d.withColumns({
        **_common("dynamic-linkage", F.col("fmt")), "confidence": F.lit("high"), "library_version": version,
        "matched": F.col("soname"), "pqc_capability": cap, "evidence_tier": F.lit("linkage"),
        "pqc_note": F.concat_ws(" ", "lib_name", version, F.lit("capability"), cap),
        "reasoning": F.lit("named in the dynamic linkage table")}))


def symbol_detections(symbols: DataFrame) -> DataFrame:
    """Rows (file, fmt, ord, symbol): one detection per algorithm and file, from the
    first signature in table order; the role stays unknown."""
    hits = F.filter(F.array(*[F.struct(
        F.lit(i).alias("n"), F.lit(a).alias("alg"), F.regexp_substr("symbol", F.lit(rx)).alias("m"))
        for i, (rx, a) in enumerate(SYMBOLS)]), lambda h: h["m"].isNotNull())
    d = (symbols.select("file", "fmt", "ord", F.explode(hits).alias("h"))
         .groupBy("file", F.col("h.alg").alias("algorithm"))
         .agg(F.min_by(F.struct("fmt", F.col("h.m").alias("m"), F.col("h.n").alias("n")),
                       F.struct("h.n", "ord")).alias("b")))
    size = F.when(F.col("algorithm").startswith("aes-"), F.element_at(F.split("algorithm", "-"), 2).cast("int"))
    return conform(d.withColumns({
        **_common("symbol-table", F.col("b.fmt")), "ord": F.lit(10**6) + F.col("b.n"), "confidence": F.lit("medium"),
        "role": F.lit(kb.UNKNOWN), "key_size": size, "matched": F.col("b.m"), "evidence_tier": F.lit("symbol"),
        "reasoning": F.lit("symbol names its parameters; use is not shown")}))


def binary_facts(fmt: Column, content: Column) -> Column:
    """Protocol versions named in marker strings, and the library version a binary names."""
    def of_text(text):
        strings = F.filter(F.regexp_extract_all(text, F.lit(PRINTABLE), F.lit(0)), lambda s: s.rlike(MARKERS))

        def of_blob(blob):
            return F.array_compact(F.array(*[F.when(blob.rlike(rx), fact("binary-string", rule=i, c=fmt)) for i, (rx, _, _) in enumerate(TLS_STRINGS)]))

        version = F.regexp_extract(text, OPENSSL_VERSION, 1)
        return together(let(F.array_join(strings, "\n"), of_blob), F.when(version != "", F.array(fact("openssl-version", a=version, c=fmt))))

    return F.when(fmt.isNotNull(), let(F.decode(content, "ISO-8859-1"), of_text))


def refine(facts: DataFrame) -> DataFrame:
    d = facts.where("fact = 'binary-string'").withColumns({
        "p": lookup(F.col("rule"), {i: p for i, (_, p, _) in enumerate(TLS_STRINGS)}), "v": lookup(F.col("rule"), {i: v for i, (_, _, v) in enumerate(TLS_STRINGS)})})
    return conform(d.withColumns({
        **_common("strings", F.col("c")), "file": F.col("path"), "ord": F.lit(2 * 10**6) + F.col("rule"), "confidence": F.lit("low"),
        "protocol": F.col("p"), "protocol_version": F.col("v"), "matched": F.concat("p", "v"),
        "evidence_tier": F.lit("string"), "reasoning": F.lit("string literal; support, not negotiation")}))


def string_detections(binaries: DataFrame) -> DataFrame:
    """Rows (file, fmt, content): protocol versions named in marker strings."""
    return refine(exploded(binaries.withColumnRenamed("file", "path"), binary_facts(F.col("fmt"), F.col("content"))))


def openssl_versions(facts: DataFrame) -> DataFrame:
    """(file, openssl_version) of binaries that name one."""
    return facts.where("fact = 'openssl-version'").groupBy(F.col("path").alias("file")).agg(F.min("a").alias("openssl_version"))
