"""Detectors over large files, comments, strings and statements of several lines."""

import time

from cipherledger.operators import binaries, callsites, lexical, manifests
from cipherledger.operators.facts import facts_of
from cipherledger.sources import files


def run(spark, path, text):
    return spark.createDataFrame([(path, text)], "path string, text string")


def test_long_manifest_is_linear(spark):
    text = "\n".join(f"github.com/org{i}/lib/jwt v1.{i}.0 h1:abc=" for i in range(20_000))
    start = time.time()
    rows = facts_of(run(spark, "a/go.sum", text), manifests.go_facts).selectExpr("count(*) AS n", "max(line) AS last", "max_by(b, line) AS v").first()
    assert (rows.n, rows.last, rows.v) == (20_000, 20_000, "1.19999.0")
    assert time.time() - start < 60


def test_long_source_file(spark):
    text = "import hashlib\n" + "\n".join(f"x{i} = print(len(str({i})))\nh{i} = hashlib.sha256(x{i})" for i in range(2_500))
    start = time.time()
    out = callsites.call_detections(run(spark, "a.py", text)).selectExpr("count(*) AS n", "max(line) AS last").first()
    assert (out.n, out.last) == (2_500, 5_001) and time.time() - start < 90


def test_call_sites_of_all_shapes(spark):
    text = '''import hashlib
from cryptography.hazmat.primitives.asymmetric import (
    rsa,
    ec,
)
# h = hashlib.md5(data)
"""Uses hashlib.md5(data) once,
and hashlib.sha1(data)."""
note = "see hashlib.md5(data)"
key = rsa.generate_private_key(
    public_exponent=65537,  # the usual (one)
    key_size=1024,
)
digest = hashlib.new("sha1", b"x # no comment")  # hashlib.md5(y)
'''
    got = {(r.line, r.algorithm, r.key_size) for r in callsites.call_detections(run(spark, "a.py", text)).collect()}
    assert got == {(10, "rsa", 1024), (14, "sha-1", None)}


def test_nothing_is_cut(spark):
    line = "x" * 10_000 + " AES-256-GCM"
    assert lexical.lexical_detections(run(spark, "a.java", line)).count() > 0
    blob = b"\x00".join(b"OpenSSL marker %d" % i for i in range(1_000)) + b"\x00" + b"y" * 300 + b"TLSv1.2\x00"
    out = binaries.string_detections(spark.createDataFrame([("a.so", "elf", bytearray(blob))], "file string, fmt string, content binary")).collect()
    assert [(r.protocol, r.protocol_version) for r in out] == [("TLS", "1.2")]
    big = spark.createDataFrame([("a.py", 3 << 20, bytearray(b"x = 1\n" * (1 << 19))), ("b.py", 9_001, bytearray(b"a" * 9_000 + b"\x00"))], "path string, length long, content binary")
    kinds = {r.path: (r.kind, r.skip_reason) for r in files.route(big).collect()}
    assert kinds == {"a.py": ("text", None), "b.py": ("skipped", "binary-content")}
    assert {r.path: r.skip_reason for r in files.route(big, 2 << 20).collect()}["a.py"] == "too-large"
