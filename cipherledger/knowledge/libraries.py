"""Cryptographic library knowledge base."""

from __future__ import annotations

# Fixed values, in lookup order: id, name, ecosystem, post-quantum support, first
# version with it, package names, sonames, aliases.
LIBRARIES = [
    ("openssl", "OpenSSL", "c", "native", "3.5", "openssl libssl libssl1.1 libssl3 openssl-libs libcrypto libssl-dev", "libssl.so libcrypto.so libssl.dylib libcrypto.dylib", ""),
    ("boringssl", "BoringSSL", "c", "native", None, "boringssl", "libssl", ""),
    ("libressl", "LibreSSL", "c", "none", None, "libressl", "libtls.so", ""),
    ("libsodium", "libsodium", "c", "none", None, "libsodium libsodium23 pynacl sodium", "libsodium.so", ""),
    ("wolfssl", "wolfSSL", "c", "native", None, "wolfssl", "libwolfssl.so", ""),
    ("gnutls", "GnuTLS", "c", "native", None, "gnutls libgnutls30", "libgnutls.so", ""),
    ("nss", "Mozilla NSS", "c", "native", None, "nss libnss3", "libnss3.so libssl3.so", ""),
    ("bouncycastle", "Bouncy Castle", "java", "native", None, "bcprov-jdk18on bcprov-jdk15on bcpkix-jdk18on bctls-jdk18on org.bouncycastle", "", "bc bcprov"),
    ("jca", "Java JCA/JCE (SunJCE)", "java", "provider", None, "javax.crypto java.security", "", "sunjce jce jca"),
    ("python-cryptography", "python cryptography (pyca)", "python", "provider", None, "cryptography", "", ""),
    ("pycryptodome", "PyCryptodome", "python", "none", None, "pycryptodome pycryptodomex pycrypto", "", "crypto cryptodome"),
    ("pyopenssl", "pyOpenSSL", "python", "provider", None, "pyopenssl", "", ""),
    ("paramiko", "Paramiko (SSH)", "python", "none", None, "paramiko", "", ""),
    ("node-crypto", "Node.js crypto", "node", "provider", None, "crypto node:crypto", "", ""),
    ("node-forge", "node-forge", "node", "none", None, "node-forge", "", ""),
    ("jsrsasign", "jsrsasign", "node", "none", None, "jsrsasign", "", ""),
    ("go-crypto", "Go standard crypto", "go", "native", None, "crypto/tls crypto/rsa crypto/ecdsa crypto/mlkem crypto/x509 crypto/ed25519 crypto/aes crypto/sha256", "", ""),
    ("rustls", "rustls", "rust", "native", None, "rustls rustls-webpki", "", ""),
    ("rust-crypto", "RustCrypto crates", "rust", "provider", None, "aes-gcm sha2 rsa p256 ed25519-dalek x25519-dalek ring chacha20poly1305 ml-kem", "", ""),
    ("aws-lc", "AWS-LC", "c", "native", None, "aws-lc aws-lc-rs", "libcrypto.so", ""),
    ("openssh", "OpenSSH", "c", "native", "9.0", "openssh openssh-client openssh-server", "", ""),
    ("mbedtls", "Mbed TLS", "c", "provider", None, "mbedtls", "libmbedtls.so libmbedcrypto.so", ""),
    ("jsse", "Java JSSE (TLS)", "java", "provider", None, "javax.net.ssl", "", ""),
]

LIB_COLUMNS = ("lib_id", "lib_ord", "lib_name", "lib_pqc", "lib_since")


def lib_rows():
    return [(l[0], i, l[1], l[3], l[4]) for i, l in enumerate(LIBRARIES)]


def package_rows():
    """(ord, spelling, library id) in lookup order; a spelling belongs to the first
    library that lists it as a package, while ids and names always win."""
    index: dict[str, str] = {}
    for l in LIBRARIES:
        index[l[0]] = l[0]
        index[l[1].lower()] = l[0]
        for name in l[5].split() + l[7].split():
            index.setdefault(name.lower(), l[0])
    return [(i, pkg, lib) for i, (pkg, lib) in enumerate(index.items())]


def hint_rows():
    """(ord, token, library id) for the substring hint on a source line."""
    out = []
    for l in LIBRARIES:
        for token in [l[0], *l[5].split()]:
            if len(token) >= 5:
                out.append((len(out), token.lower(), l[0]))
    return out


def soname_rows():
    """(ord, soname stem, library id) for linkage tables."""
    out = []
    for l in LIBRARIES:
        for so in l[6].split():
            out.append((len(out), so.split(".")[0], l[0]))
    return out
