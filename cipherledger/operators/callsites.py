"""Python call sites: calls found by bracket depth, resolved through the file's imports.

A file's calls come as facts from one Arrow batch function (``functions.python_calls``), which
sees a file at a time: each call keeps its own line, its arguments, the integers and random
buffers they stand for, how the name it is assigned to is used, and the mode that stands next
to it. What they mean is decided here, by columns. Role refinement takes the lowest line.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case, extension, lookup
from ..functions import python_calls as scanner
from ..knowledge import algorithms as kb
from ..sources.schemas import DETECTOR_RANK, conform
from .config import resolve_name
from .facts import CALL, exploded, fact
from .normalize import with_algorithm

PYCA, PYC = "python-cryptography", "pycryptodome"
# Api suffix -> algorithm, role, library, argument (what, where).
APIS = [
    ("asymmetric.rsa.generate_private_key", "rsa", kb.UNKNOWN, PYCA, "size", "key_size"),
    ("asymmetric.dsa.generate_private_key", "dsa", kb.SIG, PYCA, "size", "key_size"),
    ("asymmetric.ec.generate_private_key", "ecdsa", kb.UNKNOWN, PYCA, "curve", "0"),
    ("asymmetric.ed25519.Ed25519PrivateKey.generate", "ed25519", kb.SIG, PYCA, None, None),
    ("asymmetric.ed448.Ed448PrivateKey.generate", "ed448", kb.SIG, PYCA, None, None),
    ("asymmetric.x25519.X25519PrivateKey.generate", "x25519", kb.KE, PYCA, None, None),
    ("asymmetric.x448.X448PrivateKey.generate", "x448", kb.KE, PYCA, None, None),
    ("asymmetric.dh.generate_parameters", "dh", kb.KE, PYCA, "size", "key_size"),
    ("asymmetric.padding.OAEP", "rsa", kb.KT, PYCA, None, None),
    ("asymmetric.padding.PKCS1v15", "rsa", kb.UNKNOWN, PYCA, None, None),
    ("asymmetric.padding.PSS", "rsa", kb.SIG, PYCA, None, None),
    ("ciphers.algorithms.AES", "aes-128", kb.ENC, PYCA, "key", "0"),
    ("ciphers.algorithms.TripleDES", "3des", kb.ENC, PYCA, None, None),
    ("ciphers.algorithms.ChaCha20", "chacha20", kb.ENC, PYCA, None, None),
    ("ciphers.algorithms.Blowfish", "blowfish", kb.ENC, PYCA, None, None),
    ("ciphers.algorithms.ARC4", "rc4", kb.ENC, PYCA, None, None),
    ("ciphers.aead.AESGCM", "aes-128", kb.ENC, PYCA, "key", "0"),
    ("ciphers.aead.AESCCM", "aes-128", kb.ENC, PYCA, "key", "0"),
    ("ciphers.aead.ChaCha20Poly1305", "chacha20-poly1305", kb.ENC, PYCA, None, None),
    ("hashes.MD5", "md5", kb.HASH, PYCA, None, None), ("hashes.SHA1", "sha-1", kb.HASH, PYCA, None, None),
    ("hashes.SHA224", "sha-224", kb.HASH, PYCA, None, None), ("hashes.SHA256", "sha-256", kb.HASH, PYCA, None, None),
    ("hashes.SHA384", "sha-384", kb.HASH, PYCA, None, None), ("hashes.SHA512", "sha-512", kb.HASH, PYCA, None, None),
    ("hashes.SHA3_256", "sha3-256", kb.HASH, PYCA, None, None),
    ("kdf.pbkdf2.PBKDF2HMAC", "pbkdf2", kb.KDF, PYCA, None, None), ("kdf.hkdf.HKDF", "hkdf", kb.KDF, PYCA, None, None),
    ("hmac.HMAC", "hmac-sha256", kb.MAC, PYCA, None, None),
    ("hashlib.md5", "md5", kb.HASH, None, None, None), ("hashlib.sha1", "sha-1", kb.HASH, None, None, None),
    ("hashlib.sha224", "sha-224", kb.HASH, None, None, None), ("hashlib.sha256", "sha-256", kb.HASH, None, None, None),
    ("hashlib.sha384", "sha-384", kb.HASH, None, None, None), ("hashlib.sha512", "sha-512", kb.HASH, None, None, None),
    ("hashlib.sha3_256", "sha3-256", kb.HASH, None, None, None), ("hashlib.pbkdf2_hmac", "pbkdf2", kb.KDF, None, None, None),
    ("hashlib.new", None, kb.HASH, None, "name", "0"), ("hmac.new", "hmac-sha256", kb.MAC, None, "digest", "digestmod"),
    ("Cipher.AES.new", "aes-128", kb.ENC, PYC, "key", "0"), ("Cipher.DES3.new", "3des", kb.ENC, PYC, None, None),
    ("Cipher.DES.new", "des", kb.ENC, PYC, None, None), ("Cipher.ARC4.new", "rc4", kb.ENC, PYC, None, None),
    ("PublicKey.RSA.generate", "rsa", kb.UNKNOWN, PYC, "size", "0"), ("PublicKey.ECC.generate", "ecdsa", kb.UNKNOWN, PYC, "curve", "curve"),
    ("Hash.MD5.new", "md5", kb.HASH, PYC, None, None), ("Hash.SHA1.new", "sha-1", kb.HASH, PYC, None, None),
    ("Hash.SHA256.new", "sha-256", kb.HASH, PYC, None, None), ("Signature.pkcs1_15.new", "rsa", kb.SIG, PYC, None, None),
    ("Signature.pss.new", "rsa", kb.SIG, PYC, None, None), ("Cipher.PKCS1_OAEP.new", "rsa", kb.KT, PYC, None, None),
    ("ssl.SSLContext", None, None, "openssl", "tls", "0"), ("ssl.wrap_socket", None, None, "openssl", None, None),
    ("paramiko.SSHClient", None, None, "paramiko", None, None),
    ("paramiko.RSAKey.from_private_key_file", "rsa", kb.SIG, "paramiko", None, None),
    ("paramiko.Ed25519Key", "ed25519", kb.SIG, "paramiko", None, None),
    ("jwt.encode", None, kb.SIG, None, "jwt", "algorithm"), ("jwt.decode", None, kb.SIG, None, "jwt", "algorithms"),
]
# Method on a key object -> role; token algorithm -> id; TLS constants; curves.
ROLE_OF_METHOD = {"sign": kb.SIG, "verify": kb.VER, "decrypt": kb.DEC, "encrypt": kb.ENC,
                  "exchange": kb.KE, "derive": kb.KDF, "encapsulate": kb.KE, "decapsulate": kb.KE}
JWT = {"HS256": "hmac-sha256", "HS384": "hmac-sha256", "HS512": "hmac-sha256", "RS256": "rsa",
       "RS384": "rsa", "RS512": "rsa", "PS256": "rsa", "PS384": "rsa", "PS512": "rsa",
       "ES256": "ecdsa", "ES384": "ecdsa", "ES512": "ecdsa", "EdDSA": "ed25519"}
TLS_CONSTANTS = {"PROTOCOL_TLSv1": ("TLS", "1.0"), "PROTOCOL_TLSv1_1": ("TLS", "1.1"),
                 "PROTOCOL_TLSv1_2": ("TLS", "1.2"), "PROTOCOL_SSLv3": ("SSL", "3.0"),
                 "PROTOCOL_SSLv23": ("TLS", "negotiated"), "PROTOCOL_TLS": ("TLS", "negotiated"),
                 "PROTOCOL_TLS_CLIENT": ("TLS", "negotiated"), "PROTOCOL_TLS_SERVER": ("TLS", "negotiated")}
CURVES = {"SECP192R1": "secp192r1", "SECP224R1": "secp224r1", "SECP256R1": "secp256r1",
          "SECP256K1": "secp256k1", "SECP384R1": "secp384r1", "SECP521R1": "secp521r1",
          "BrainpoolP256R1": "brainpoolp256r1", "BrainpoolP384R1": "brainpoolp384r1"}
MODES = ("gcm", "cbc", "ctr", "ccm", "ecb", "ofb", "cfb")
LEAVES = sorted({a[0].rsplit(".", 1)[-1] for a in APIS})
#: Arguments that some api asks for, and the second one, which names a mode.
ARGUMENTS = sorted({a[5] for a in APIS if a[5]} | {"1"})


@cache
def _call_function():
    """Calls of a batch of texts; made once there is a session. The scanner travels with the
    function, so workers need not find this package."""
    cloudpickle.register_pickle_by_value(scanner)
    find_calls = scanner.find_calls
    kind = pa.list_(pa.struct([
        ("line", pa.int32()), ("k", pa.int32()), ("callee", pa.string()), ("canon", pa.string()), ("args", pa.map_(pa.string(), pa.string())),
        ("integers", pa.map_(pa.string(), pa.int64())), ("sizes", pa.map_(pa.string(), pa.int64())), ("method", pa.string()), ("sibling", pa.string()), ("text", pa.string())]))
    leaves, keywords, methods, modes = set(LEAVES), set(ARGUMENTS), set(ROLE_OF_METHOD), set(MODES)

    def calls(texts: pa.Array) -> pa.Array:
        rows = [find_calls(t.as_py(), leaves, keywords, methods, modes) for t in texts]
        maps = ("args", "integers", "sizes")
        return pa.array([[r | {m: list(r[m].items()) for m in maps} for r in row] for row in rows], kind)

    return F.arrow_udf(calls, f"array<{CALL}>")


def python_calls(text: Column) -> Column:
    """Calls of Python files that may matter; other files are not sent to Python."""
    return _call_function()(F.when(extension(F.col("path")).isin(".py", ".pyi"), text))


def call_facts(calls: Column) -> Column:
    return F.transform(calls, lambda c: fact("call", line=c["line"], pos=c["k"], source=c["text"], call=c))


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def matched_api(canon: Column, dotted: Column) -> Column:
    """Exact name, else the longest dotted suffix that is a known API."""
    index = F.create_map(*[F.lit(v) for a in APIS for v in (a[0], a[0])])

    def suffixes(name):
        parts = F.split(name, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    hits = F.filter(F.concat(suffixes(canon), suffixes(dotted)), lambda s: index[s].isNotNull())
    longest = F.array_max(F.transform(hits, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    return F.coalesce(index[canon], index[dotted], longest)


def call_detections(files: DataFrame) -> DataFrame:
    """High-confidence detections of resolved calls to known cryptographic APIs."""
    python = files.where(extension(F.col("path")).isin(".py", ".pyi"))
    called = python.select("path", python_calls(F.col("text")).alias("calls"))
    return refine(exploded(called, call_facts(F.col("calls"))))


def refine(facts: DataFrame) -> DataFrame:
    c = F.col
    rows = facts.where("fact = 'call'").select("path", "call.*")
    # A one-element explode is a fence: filters further up are not rewritten into copies
    # of the expressions below it.
    rows = rows.select("path", F.explode_outer(F.array(F.struct(*[c(n) for n in rows.columns if n != "path"], matched_api(c("canon"), c("callee")).alias("api")))).alias("r")).where(
        "r.api IS NOT NULL").select("path", "r.*")
    by = lambda i: lookup(c("api"), {a[0]: a[i] for a in APIS if a[i] is not None})
    rows = rows.withColumns({"base": by(1), "api_role": by(2), "library": by(3), "what": by(4), "where": by(5)})
    at = lambda m: F.try_element_at(c(m), c("where"))
    rows = rows.withColumns({"arg": at("args"), "integer": at("integers"), "size": at("sizes")})
    arg, what = c("arg"), c("what")
    nbytes = F.when(what == "key", c("size"))
    leaf = F.regexp_replace(F.regexp_replace(arg, r"['\"]", ""), r"(?s)\(.*$", "")
    leaf = F.element_at(F.split(leaf, r"\."), -1)
    text_value = _some(F.regexp_extract(arg, r"^['\"]([^'\"]*)['\"]$", 1))
    tokens = F.regexp_extract_all(arg, F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1))
    jwt_ids = F.array_compact(F.transform(tokens, lambda t: lookup(t, JWT)))
    digest = F.replace(F.lower(leaf), F.lit("-"), F.lit(""))
    # A digest other than these three keeps the default keyed hash only when it says 256.
    mac = case((F.contains(digest, F.lit("md5")), "hmac-md5"), (F.contains(digest, F.lit("sha1")), "hmac-sha1"),
               (F.contains(digest, F.lit("256")), "hmac-sha256"),
               (resolve_name(leaf).isNotNull(), F.concat(F.lit("hmac-"), F.replace(resolve_name(leaf), F.lit("-"), F.lit("")))),
               otherwise=c("base"))
    algorithm = case(
        ((what == "key") & nbytes.isin(16, 24, 32), F.concat(F.lit("aes-"), (nbytes * 8).cast("string"))),
        ((what == "name") & text_value.isNotNull(), F.coalesce(resolve_name(text_value), c("base"))),
        ((what == "digest") & arg.isNotNull(), mac),
        (what == "jwt", F.try_element_at(jwt_ids, F.lit(1))), otherwise=c("base"))
    is_ssl = c("api").startswith("ssl.")
    const_p = lookup(leaf, {k: v[0] for k, v in TLS_CONSTANTS.items()})
    const_v = lookup(leaf, {k: v[1] for k, v in TLS_CONSTANTS.items()})
    rows = rows.withColumns({
        "algorithm": algorithm,
        "protocol": F.when(is_ssl, F.coalesce(F.when(what == "tls", const_p), F.lit("TLS"))),
        "protocol_version": F.when(is_ssl, F.coalesce(F.when((what == "tls") & const_p.isNotNull(), const_v), F.lit("negotiated"))),
        "key_size": case((what == "size", c("integer")), (what == "key", nbytes * 8)).try_cast("int"),
        "curve": F.when(what == "curve", F.coalesce(lookup(leaf, CURVES), F.lower(leaf)))})
    d = with_algorithm(rows).where("algorithm IS NOT NULL OR protocol IS NOT NULL")
    unset = c("api_role").isNull() | (c("api_role") == kb.UNKNOWN)
    derived = F.when(c("kb_default_role") != kb.UNKNOWN, c("kb_default_role"))
    role = F.when(~unset, c("api_role")).otherwise(F.coalesce(lookup(c("method"), ROLE_OF_METHOD), derived, F.lit(kb.UNKNOWN)))
    # One api names its mode in the second argument; any other cipher takes the mode of a
    # sibling argument.
    named = F.lower(F.element_at(F.split(F.try_element_at(c("args"), F.lit("1")), r"\."), -1))
    own = F.when(c("api") == "Cipher.AES.new", case(*[(F.contains(named, F.lit(m)), m) for m in MODES]))
    cipher = c("kb_primitive").isin("block-cipher", "stream-cipher", "ae")
    refined = lookup(c("method"), ROLE_OF_METHOD).isNotNull()
    return conform(d.withColumns({
        "file": c("path"), "det_rank": F.lit(DETECTOR_RANK["python-ast"]), "sub": F.lit(0),
        "ord": c("line").cast("bigint") * 10**6 + c("k"), "detector": F.lit("python-ast"), "mode": F.when(cipher, F.coalesce(own, c("sibling"))),
        "confidence": F.lit("high"), "role": role, "reasoning": F.when(unset & refined, "role from use of the key object").otherwise("call resolved through imports"),
        "language": F.lit("python"), "snippet": c("text"), "matched": c("canon"), "api_call": c("canon")}).withColumn("method", F.lit("ast-call")))
