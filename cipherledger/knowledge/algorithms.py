"""Algorithm knowledge base, roles and strength tables."""

from __future__ import annotations

KE, KT = "key-establishment", "key-transport"
SIG, VER = "digital-signature", "signature-verification"
ENC, DEC = "encryption", "decryption"
HASH, MAC, KDF = "hashing", "message-authentication", "key-derivation"
AUTH, CERTVAL = "authentication", "certificate-validation"
UNKNOWN = "unknown"

# Role -> decision family.
ROLE_FAMILY = {
    KE: "key-establishment", KT: "key-establishment",
    SIG: "signature", VER: "signature", AUTH: "signature", CERTVAL: "signature",
    ENC: "symmetric", DEC: "symmetric",
    HASH: "hash", MAC: "hash", KDF: "kdf", UNKNOWN: "unknown",
}

ROLES = (SIG, VER, KE, KT, ENC, DEC, AUTH, CERTVAL, HASH, KDF, MAC, UNKNOWN)

SHOR, GROVER, BROKEN = "shor_broken", "grover_reduced", "classically_broken"
PQC, SELECTED, HYBRID = "pqc_standardized", "pqc_selected", "hybrid_pqt"

# Id, name, family, primitive, roles, functions, quantum class, status,
# oid, standard, strength in bits at the default parameters, aliases.
ALGORITHMS = [
    ("rsa", "RSA", "RSA", "pke", (KT, SIG, VER, ENC, DEC), "encrypt decrypt sign verify keygen", SHOR, "legacy", "1.2.840.113549.1.1.1", "FIPS 186-5 / PKCS#1", 112, ""),
    ("dsa", "DSA", "DSA", "signature", (SIG, VER), "sign verify keygen", SHOR, "deprecated", "1.2.840.10040.4.1", "FIPS 186-4 (withdrawn for signing in 186-5)", 112, ""),
    ("ecdsa", "ECDSA", "EC", "signature", (SIG, VER), "sign verify keygen", SHOR, "approved", "1.2.840.10045.2.1", "FIPS 186-5", 128, ""),
    ("ed25519", "Ed25519", "EdDSA", "signature", (SIG, VER), "sign verify keygen", SHOR, "approved", "1.3.101.112", "FIPS 186-5 / RFC 8032", 128, "eddsa"),
    ("ed448", "Ed448", "EdDSA", "signature", (SIG, VER), "sign verify keygen", SHOR, "approved", "1.3.101.113", "FIPS 186-5 / RFC 8032", 224, ""),
    ("dh", "Diffie-Hellman", "DH", "key-agree", (KE,), "keyderive generate", SHOR, "legacy", "1.2.840.113549.1.3.1", "SP 800-56A", 112, "diffie-hellman dhe"),
    ("ecdh", "ECDH", "EC", "key-agree", (KE,), "keyderive generate", SHOR, "approved", "1.3.132.1.12", "SP 800-56A", 128, "ecdhe"),
    ("x25519", "X25519", "EC", "key-agree", (KE,), "keyderive generate", SHOR, "approved", "1.3.101.110", "RFC 7748 / SP 800-186", 128, ""),
    ("x448", "X448", "EC", "key-agree", (KE,), "keyderive generate", SHOR, "approved", "1.3.101.111", "RFC 7748", 224, ""),
    ("elgamal", "ElGamal", "ElGamal", "pke", (ENC, DEC), "encrypt decrypt", SHOR, "legacy", None, None, 112, ""),
    ("aes-128", "AES-128", "AES", "block-cipher", (ENC,), "encrypt decrypt", GROVER, "approved", "2.16.840.1.101.3.4.1.2", "FIPS 197", 128, ""),
    ("aes-192", "AES-192", "AES", "block-cipher", (ENC,), "encrypt decrypt", GROVER, "approved", "2.16.840.1.101.3.4.1.22", "FIPS 197", 192, ""),
    ("aes-256", "AES-256", "AES", "block-cipher", (ENC,), "encrypt decrypt", GROVER, "approved", "2.16.840.1.101.3.4.1.42", "FIPS 197", 256, ""),
    ("chacha20", "ChaCha20", "ChaCha", "stream-cipher", (ENC,), "encrypt decrypt", GROVER, "approved", None, "RFC 8439", 256, ""),
    ("chacha20-poly1305", "ChaCha20-Poly1305", "ChaCha", "ae", (ENC,), "encrypt decrypt tag", GROVER, "approved", None, "RFC 8439", 256, ""),
    ("3des", "3DES (TDEA)", "DES", "block-cipher", (ENC,), "encrypt decrypt", BROKEN, "deprecated", "1.2.840.113549.3.7", "SP 800-67 (disallowed after 2023)", 112, "des-ede3 tripledes desede"),
    ("des", "DES", "DES", "block-cipher", (ENC,), "encrypt decrypt", BROKEN, "broken", "1.3.14.3.2.7", None, 56, ""),
    ("rc4", "RC4", "RC4", "stream-cipher", (ENC,), "encrypt decrypt", BROKEN, "broken", None, None, 0, ""),
    ("blowfish", "Blowfish", "Blowfish", "block-cipher", (ENC,), "encrypt decrypt", BROKEN, "deprecated", None, None, 64, ""),
    ("md5", "MD5", "MD", "hash", (HASH,), "digest", BROKEN, "broken", "1.2.840.113549.2.5", None, 0, ""),
    ("sha-1", "SHA-1", "SHA", "hash", (HASH,), "digest", BROKEN, "broken", "1.3.14.3.2.26", "FIPS 180-4 (disallowed for signatures)", 63, "sha1"),
    ("sha-224", "SHA-224", "SHA-2", "hash", (HASH,), "digest", GROVER, "approved", "2.16.840.1.101.3.4.2.4", "FIPS 180-4", 112, ""),
    ("sha-256", "SHA-256", "SHA-2", "hash", (HASH,), "digest", GROVER, "approved", "2.16.840.1.101.3.4.2.1", "FIPS 180-4", 128, ""),
    ("sha-384", "SHA-384", "SHA-2", "hash", (HASH,), "digest", GROVER, "approved", "2.16.840.1.101.3.4.2.2", "FIPS 180-4", 192, ""),
    ("sha-512", "SHA-512", "SHA-2", "hash", (HASH,), "digest", GROVER, "approved", "2.16.840.1.101.3.4.2.3", "FIPS 180-4", 256, ""),
    ("sha3-256", "SHA3-256", "SHA-3", "hash", (HASH,), "digest", GROVER, "approved", "2.16.840.1.101.3.4.2.8", "FIPS 202", 128, "sha3"),
    ("sha3-512", "SHA3-512", "SHA-3", "hash", (HASH,), "digest", GROVER, "approved", "2.16.840.1.101.3.4.2.10", "FIPS 202", 256, ""),
    ("shake256", "SHAKE256", "SHA-3", "xof", (HASH,), "digest", GROVER, "approved", None, "FIPS 202", 256, ""),
    ("hmac-sha256", "HMAC-SHA-256", "HMAC", "mac", (MAC,), "tag", GROVER, "approved", None, "FIPS 198-1", 128, ""),
    ("hmac-sha1", "HMAC-SHA-1", "HMAC", "mac", (MAC,), "tag", GROVER, "legacy", None, "FIPS 198-1", 128, ""),
    ("hmac-md5", "HMAC-MD5", "HMAC", "mac", (MAC,), "tag", BROKEN, "deprecated", None, None, 64, ""),
    ("pbkdf2", "PBKDF2", "PBKDF", "kdf", (KDF,), "keyderive", GROVER, "approved", None, "SP 800-132", 128, ""),
    ("hkdf", "HKDF", "HKDF", "kdf", (KDF,), "keyderive", GROVER, "approved", None, "RFC 5869 / SP 800-56C", 128, ""),
    ("md5crypt", "MD5-crypt", "MD", "kdf", (KDF,), "keyderive", BROKEN, "broken", None, None, 0, ""),
    ("ml-kem-512", "ML-KEM-512", "ML-KEM", "kem", (KE,), "encapsulate decapsulate keygen", PQC, "pqc-standardized", None, "FIPS 203", 128, "kyber512"),
    ("ml-kem-768", "ML-KEM-768", "ML-KEM", "kem", (KE,), "encapsulate decapsulate keygen", PQC, "pqc-standardized", None, "FIPS 203", 192, "kyber768"),
    ("ml-kem-1024", "ML-KEM-1024", "ML-KEM", "kem", (KE,), "encapsulate decapsulate keygen", PQC, "pqc-standardized", None, "FIPS 203", 256, "kyber1024"),
    ("ml-dsa-44", "ML-DSA-44", "ML-DSA", "signature", (SIG, VER), "sign verify keygen", PQC, "pqc-standardized", None, "FIPS 204", 128, "dilithium2"),
    ("ml-dsa-65", "ML-DSA-65", "ML-DSA", "signature", (SIG, VER), "sign verify keygen", PQC, "pqc-standardized", None, "FIPS 204", 192, "dilithium3"),
    ("ml-dsa-87", "ML-DSA-87", "ML-DSA", "signature", (SIG, VER), "sign verify keygen", PQC, "pqc-standardized", None, "FIPS 204", 256, "dilithium5"),
    ("slh-dsa-sha2-128s", "SLH-DSA-SHA2-128s", "SLH-DSA", "signature", (SIG, VER), "sign verify keygen", PQC, "pqc-standardized", None, "FIPS 205", 128, "sphincs+"),
    ("slh-dsa-sha2-192s", "SLH-DSA-SHA2-192s", "SLH-DSA", "signature", (SIG, VER), "sign verify keygen", PQC, "pqc-standardized", None, "FIPS 205", 192, ""),
    ("hqc", "HQC", "HQC", "kem", (KE,), "encapsulate decapsulate keygen", SELECTED, "pqc-selected", None, "NIST 4th-round selection (2025) -- draft FIPS pending", 128, ""),
    ("lms", "LMS", "HBS", "signature", (SIG, VER), "sign verify", PQC, "approved", None, "SP 800-208 / RFC 8554", 128, ""),
    ("x25519mlkem768", "X25519MLKEM768", "PQ/T Hybrid", "combiner", (KE,), "encapsulate decapsulate keyderive", HYBRID, "approved", None, "RFC 10024 (TLS group 0x11EC / 4588, Recommended=Y)", 192, ""),
    ("secp256r1mlkem768", "SecP256r1MLKEM768", "PQ/T Hybrid", "combiner", (KE,), "encapsulate decapsulate keyderive", HYBRID, "approved", None, "RFC 10024 (TLS group 0x11EB / 4587, Recommended=N)", 192, ""),
    ("secp384r1mlkem1024", "SecP384r1MLKEM1024", "PQ/T Hybrid", "combiner", (KE,), "encapsulate decapsulate keyderive", HYBRID, "approved", None, "RFC 10024 (TLS group 0x11ED / 4589, Recommended=N)", 256, ""),
    ("x25519kyber768draft00", "X25519Kyber768Draft00", "PQ/T Hybrid (obsolete)", "combiner", (KE,), "keyderive", HYBRID, "deprecated", None, "Obsoleted by RFC 10024 (registry code point 25497, Recommended=D)", 192, ""),
]

# Smallest modulus of each step -> bits; below the first step 40 bits.
MODULUS_STRENGTH = [(1024, 80), (2048, 112), (3072, 128), (4096, 152), (7680, 192), (15360, 256)]
MODULUS_FLOOR_BITS = 40
MODULUS_FAMILIES = ("RSA", "DSA", "DH", "ElGamal")

# Curve spelling -> bits.
CURVE_STRENGTH = [
    ("secp192r1", 96), ("prime192v1", 96), ("p-192", 96),
    ("secp224r1", 112), ("p-224", 112),
    ("secp256r1", 128), ("prime256v1", 128), ("p-256", 128), ("secp256k1", 128),
    ("secp384r1", 192), ("p-384", 192),
    ("secp521r1", 256), ("p-521", 256),
    ("curve25519", 128), ("x25519", 128), ("ed25519", 128),
    ("curve448", 224), ("x448", 224), ("ed448", 224),
    ("brainpoolp256r1", 128), ("brainpoolp384r1", 192),
]

# Post-quantum security category of each standardised parameter set.
PQC_CATEGORY = {
    "ml-kem-512": 1, "ml-kem-768": 3, "ml-kem-1024": 5,
    "ml-dsa-44": 2, "ml-dsa-65": 3, "ml-dsa-87": 5,
    "slh-dsa-sha2-128s": 1, "slh-dsa-sha2-128f": 1,
    "slh-dsa-sha2-192s": 3, "slh-dsa-sha2-192f": 3,
    "slh-dsa-sha2-256s": 5, "slh-dsa-sha2-256f": 5,
}


def unambiguous_role(roles) -> str:
    """The first role, if every role leads to the same decision family."""
    families = {ROLE_FAMILY[r] for r in roles}
    return roles[0] if len(families) == 1 else UNKNOWN


def identity_of(alg_id: str, family: str) -> str:
    """Parameter-size variants of one primitive share an identity when merging."""
    if family == "AES":
        return "aes"
    if family in ("ML-KEM", "ML-DSA", "SLH-DSA"):
        return family.lower()
    return alg_id


KB_COLUMNS = ("kb_id", "kb_ord", "kb_name", "kb_family", "kb_primitive", "kb_first_role",
              "kb_default_role", "kb_functions", "kb_class", "kb_status", "kb_oid",
              "kb_standard", "kb_bits", "kb_identity", "kb_category")


def kb_rows():
    return [
        (a[0], i, a[1], a[2], a[3], a[4][0], unambiguous_role(a[4]), a[5], a[6], a[7], a[8],
         a[9], a[10], identity_of(a[0], a[2]), PQC_CATEGORY.get(a[0]))
        for i, a in enumerate(ALGORITHMS)
    ]


def alias_rows():
    """(lower-case spelling, id): id and name first, declared aliases only fill gaps."""
    out: dict[str, str] = {}
    for a in ALGORITHMS:
        out[a[0]] = a[0]
        out[a[1].lower()] = a[0]
        for alias in a[11].split():
            out.setdefault(alias, a[0])
    return sorted(out.items())


def oid_rows():
    return [(a[8], a[0]) for a in ALGORITHMS if a[8]]
