"""Protocols, cipher suites, groups and key references in configuration files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case, extension, lookup
from ..functions.text import strip
from ..knowledge import algorithms as kb
from ..sources.schemas import DETECTOR_RANK, conform
from .facts import fact, facts_of, found, together
from .normalize import with_algorithm

# What makes a file a configuration file.
HINTS = ("nginx", "httpd", "apache", "ssl.conf", "tls.conf", "openssl.cnf", "openssl.conf",
         "sshd_config", "ssh_config", "ipsec.conf", "strongswan", "haproxy", "envoy",
         "postgresql.conf", "my.cnf", "application.properties", "application.yml",
         "server.xml", "web.xml", "java.security", "wsgi", "gunicorn", "traefik")
EXTENSIONS = (".conf", ".cnf", ".ini", ".properties", ".yaml", ".yml", ".toml", ".xml", ".tf",
              ".hcl", ".json", ".env")

# Fixed values, in order: directive pattern, protocol family, label.
DIRECTIVES = [
    (r"(?i)ssl_protocols\s+([^;]+);", "TLS", "nginx ssl_protocols"),
    (r"(?imd)SSLProtocol\s+(.+)$", "TLS", "apache SSLProtocol"),
    (r"(?imd)^\s*(?:min_)?tls[-_ ]?version\s*[:=]\s*['\"]?([A-Za-z0-9._]+)", "TLS", "tls version setting"),
    (r"(?i)minimum_protocol_version\s*=\s*\"?([A-Za-z0-9._]+)", "TLS", "cloud TLS policy"),
    (r"(?imd)^\s*Protocol\s+(\d(?:,\s*\d)*)\s*$", "SSH", "sshd Protocol"),
    (r"(?imd)^\s*ike[-_ ]?version\s*[:=]\s*(\S+)", "IKE", "ipsec ike version"),
]
TLS_TOKEN = (r"(?i)\b(SSLv2|SSLv3|TLSv?1\.3|TLSv?1\.2|TLSv?1\.1|TLSv?1\.0|TLSv1|"
             r"TLS1[._]?3|TLS1[._]?2|TLS1[._]?1|TLS1[._]?0|TLS_1_[0-3])\b")
VERSIONS = {
    "sslv2": ("SSL", "2.0"), "sslv3": ("SSL", "3.0"), "tlsv1": ("TLS", "1.0"),
    "tlsv1.0": ("TLS", "1.0"), "tls1.0": ("TLS", "1.0"), "tls10": ("TLS", "1.0"), "tls_1_0": ("TLS", "1.0"),
    "tlsv1.1": ("TLS", "1.1"), "tls1.1": ("TLS", "1.1"), "tls11": ("TLS", "1.1"), "tls_1_1": ("TLS", "1.1"),
    "tlsv1.2": ("TLS", "1.2"), "tls1.2": ("TLS", "1.2"), "tls12": ("TLS", "1.2"), "tls_1_2": ("TLS", "1.2"),
    "tlsv1_2": ("TLS", "1.2"), "tlsv1.3": ("TLS", "1.3"), "tls1.3": ("TLS", "1.3"), "tls13": ("TLS", "1.3"),
    "tls_1_3": ("TLS", "1.3"), "tlsv1_3": ("TLS", "1.3"),
}
CIPHERS = (r"(?i)(?:ssl_ciphers|SSLCipherSuite|ciphers|cipher_suites|CipherSuite|Ciphers|"
           r"ssl_conf_ciphersuites|CipherString)\s*[:= ]\s*['\"]?([^'\";\n]+)")
GROUPS = (r"(?i)(?:ssl_ecdh_curve|Curves|groups|SSLOpenSSLConfCmd\s+Groups|KexAlgorithms|"
          r"curves|supported_groups)\s*[:= ]\s*['\"]?([^'\";\n]+)")
REFERENCES = (r"(?i)(?:ssl_certificate|SSLCertificateFile|ssl_certificate_key|SSLCertificateKeyFile|"
              r"tls_cert_file|tls_key_file|HostKey|cert_file|key_file|keystore|truststore)"
              r"\s*[:= ]\s*['\"]?([^\s'\";]+)")
# Fixed values, in order: suite pattern -> algorithm.
SUITE_ALGORITHMS = [
    (r"AES[-_]?256[-_]?GCM", "aes-256"), (r"AES[-_]?128[-_]?GCM", "aes-128"),
    (r"AES[-_]?256[-_]?CBC|AES256[-_]?SHA", "aes-256"), (r"AES[-_]?128[-_]?CBC|AES128[-_]?SHA", "aes-128"),
    (r"CHACHA20[-_]?POLY1305", "chacha20-poly1305"), (r"3DES|DES[-_]?CBC3", "3des"),
    (r"\bRC4\b", "rc4"), (r"\bECDHE\b", "ecdh"), (r"\bDHE\b", "dh"), (r"\bECDSA\b", "ecdsa"),
    (r"\bRSA\b", "rsa"), (r"\bSHA384\b", "sha-384"), (r"\bSHA256\b", "sha-256"),
    (r"\bSHA\b(?!\d)", "sha-1"), (r"\bMD5\b", "md5"),
]
WEAK = r"(?i)\b(NULL|EXPORT|aNULL|eNULL|LOW|MEDIUM|DES|RC4|MD5|ADH|AECDH|PSK|SEED|IDEA)\b"
# Prefixes whose suffix is re-joined with a dash when resolving a loose name.
LOOSE_PREFIXES = ("aes", "sha3-", "sha", "rsa", "ml-kem", "ml-dsa")


def is_config(path: Column) -> Column:
    low = F.lower(path)
    return reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in HINTS]) | extension(path).isin(*EXTENSIONS)


def resolve_name(name: Column) -> Column:
    """Loose algorithm spelling to its id: exact, then with the size re-joined, then the
    part before the first dash."""
    key = F.replace(F.regexp_replace(F.lower(F.trim(name)), "_", "-"), F.lit(" "), F.lit(""))
    index = F.create_map(*[F.lit(v) for kv in kb.alias_rows() for v in kv])
    tries = [index[key]]
    for prefix in LOOSE_PREFIXES:
        rest = F.regexp_replace(F.substring(key, F.lit(len(prefix) + 1), F.length(key)), "^-+", "")
        stem = prefix.rstrip("-")
        tries.append(F.when(key.startswith(prefix), index[F.when(rest != "", F.concat(F.lit(stem + "-"), rest)).otherwise(prefix)]))
    return F.when(name != "", F.coalesce(*tries, index[F.substring_index(key, "-", 1)]))


def version_pair(token: Column, family: Column) -> tuple[Column, Column]:
    t = F.lower(token)
    squeezed = F.replace(t, F.lit("."), F.lit(""))
    proto = {k: v[0] for k, v in VERSIONS.items()}
    ver = {k: v[1] for k, v in VERSIONS.items()}
    p = F.coalesce(lookup(t, proto), lookup(squeezed, proto), family)
    v = F.coalesce(lookup(t, ver), lookup(squeezed, ver), t)
    return p, v


def _base(rows: DataFrame, **cols) -> DataFrame:
    common = {"detector": F.lit("config-semantic"), "det_rank": F.lit(DETECTOR_RANK["config-semantic"]),
              "confidence": F.lit("high"), "language": F.lit("config"), "file": F.col("path")}
    return conform(rows.withColumns({**common, **cols}))


def _placed(kind: str, m: Column, **values) -> Column:
    return fact(kind, line=m["line"], pos=m["pos"], source=m["source"], **values)


def protocol_facts(text: Column) -> Column:
    directive = lambda i: lambda m: _placed("protocol", m, rule=i, a=m["value"])
    return together(*[found(text, rx, directive(i), value=1) for i, (rx, _, _) in enumerate(DIRECTIVES)])


def suite_facts(text: Column) -> Column:
    return found(text, CIPHERS, lambda m: _placed("suite", m, a=strip(m["value"])), value=1)


def group_facts(text: Column) -> Column:
    return found(text, GROUPS, lambda m: _placed("group", m, a=strip(m["value"])), value=1)


def reference_facts(text: Column) -> Column:
    return found(text, REFERENCES, lambda m: _placed("reference", m, a=m["ref"], b=m["whole"]), whole=0, ref=1)


def config_facts(text: Column) -> Column:
    """Directives, suite strings, groups and references of a configuration file."""
    return F.when(is_config(F.col("path")), together(*[f(text) for f in (protocol_facts, suite_facts, group_facts, reference_facts)]))


def settings(files: DataFrame, *builders) -> DataFrame:
    """The facts that some of these builders find in configuration files; other files are
    left out before their texts are looked at."""
    return facts_of(files.where(is_config(F.col("path"))), *builders)


def protocol_rows(facts: DataFrame) -> DataFrame:
    """One row per version token of each directive; an SSH or IKE directive without a
    token keeps its raw value."""
    rows = facts.where("fact = 'protocol'").select(
        "path", "rule", "line", "source", "pos", F.col("a").alias("value"),
        lookup(F.col("rule"), {i: fam for i, (_, fam, _) in enumerate(DIRECTIVES)}).alias("family"),
        lookup(F.col("rule"), {i: label for i, (_, _, label) in enumerate(DIRECTIVES)}).alias("label"))
    tokens = F.regexp_extract_all("value", F.lit(TLS_TOKEN), F.lit(1))
    raw = F.when(F.col("family").isin("SSH", "IKE"), F.array(F.lit(None).cast("string")))
    rows = rows.withColumn("tokens", F.when(F.size(tokens) > 0, tokens).otherwise(raw))
    rows = rows.select("*", F.posexplode("tokens").alias("k", "token"))
    proto, ver = version_pair(F.col("token"), F.col("family"))
    plain = F.col("token").isNull()
    return _base(rows, method=F.lit("config-directive"),
                 protocol=F.when(plain, F.col("family")).otherwise(proto),
                 protocol_version=F.when(plain, strip(F.col("value"))).otherwise(ver),
                 matched=F.coalesce("token", strip(F.col("value"))), api_call=F.col("label"),
                 ord=F.col("rule").cast("bigint") * 10**9 + F.col("pos") * 1000 + F.col("k"), sub=F.lit(0),
                 snippet=F.col("source"),
                 reasoning=F.lit("protocol directive"))


def suite_rows(facts: DataFrame) -> DataFrame:
    """Algorithms of each cipher-suite string, and its weak tokens."""
    rows = facts.where("fact = 'suite'").select("path", "line", "source", "pos", F.col("a").alias("suite"))
    found = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.col("suite").rlike("(?i)" + rx), F.lit(a)) for rx, a in SUITE_ALGORITHMS])))
    snippet = F.col("source")
    algs = with_algorithm(rows.select("*", F.posexplode(found).alias("k", "algorithm")))
    role = case((F.col("kb_family") == "RSA", kb.AUTH),
                ((F.col("kb_default_role") == kb.UNKNOWN) & (F.col("kb_primitive") == "key-agree"), kb.KE),
                otherwise=F.col("kb_default_role"))
    order = F.lit(10**10).cast("bigint") + F.col("pos") * 1000
    a = _base(algs, method=F.lit("config-cipher-suite"), role=role, protocol=F.lit("TLS"),
              matched=F.col("algorithm"), api_call=F.lit("cipher-suite-config"), ord=order + F.col("k"),
              sub=F.lit(0), snippet=snippet, reasoning=F.lit("declared in a cipher-suite string"))
    weak = rows.withColumn("weak_suite_tokens", F.array_sort(F.array_distinct(F.regexp_extract_all("suite", F.lit(WEAK), F.lit(1)))))
    w = _base(weak.where(F.size("weak_suite_tokens") > 0), method=F.lit("config-cipher-suite"), protocol=F.lit("TLS"),
              matched=F.array_join("weak_suite_tokens", ","), api_call=F.lit("cipher-suite-config"),
              ord=order + 999, sub=F.lit(0), snippet=F.col("suite"),
              reasoning=F.lit("suite string permits weak families"))
    return a.unionByName(w)


def group_rows(facts: DataFrame) -> DataFrame:
    """Key-exchange groups; the streamlined-prime hybrid is recorded as X25519."""
    rows = facts.where("fact = 'group'").select("path", "line", "source", "pos", F.col("a").alias("value"))
    rows = rows.select("*", F.posexplode(F.split("value", r"[:,\s]+")).alias("k", "token")).where("token <> ''")
    rows = with_algorithm(rows.withColumn("algorithm", resolve_name(F.col("token"))))
    exchange = F.coalesce(F.col("kb_primitive").isin("key-agree", "kem", "combiner"), F.lit(False))
    prime = ~exchange & F.lower("token").startswith("sntrup")
    rows = rows.withColumns({"exchange": exchange, "prime": prime}).where("exchange OR prime")
    return _base(rows, method=F.lit("config-directive"),
                 algorithm=F.when(F.col("prime"), "x25519").otherwise(F.col("kb_id")), role=F.lit(kb.KE),
                 protocol=F.when(F.col("prime"), "SSH").otherwise("TLS"), matched=F.col("token"),
                 api_call=F.when(F.col("prime"), "ssh-kex-config").otherwise("supported-groups-config"),
                 hybrid_non_nist=F.col("prime"), ord=F.lit(2 * 10**10).cast("bigint") + F.col("pos") * 1000 + F.col("k"),
                 sub=F.lit(0), snippet=F.col("source"),
                 reasoning=F.lit("key-exchange group in configuration"))


def reference_rows(facts: DataFrame) -> DataFrame:
    """Certificate and private-key file references; only the path is recorded."""
    rows = facts.where("fact = 'reference'").select("path", "line", "source", "pos", F.col("a").alias("ref"), F.col("b").alias("whole"))
    is_key = F.col("whole").rlike("(?i)key") & ~F.contains(F.lower("whole"), F.lit("keystore"))
    return _base(rows, method=F.lit("config-directive"), matched=F.col("ref"), api_call=F.lit("pki-file-reference"),
                 ord=F.lit(3 * 10**10).cast("bigint") + F.col("pos") * 1000, sub=F.lit(0),
                 snippet=F.col("source"),
                 reasoning=F.when(is_key, "private-key file reference").otherwise("certificate reference"))


def refine(facts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [g(facts) for g in (protocol_rows, suite_rows, group_rows, reference_rows)])


def config_detections(files: DataFrame) -> DataFrame:
    return refine(settings(files, config_facts))
