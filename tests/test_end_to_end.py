"""A small folder from files to decisions, with a manifest of applications."""

import json

from pyspark.sql import functions as F

from cipherledger.operators.detect import detect
from cipherledger.plans.scan import Scan
from cipherledger.sources.estate import read_estate
from cipherledger.sources.files import route, scan_corpus


def test_folder_to_decisions(spark, tmp_path):
    root = tmp_path / "repositories"
    put = {
        "pay/src/keys.py": b"from cryptography.hazmat.primitives.asymmetric import (\n    rsa,\n)\nkey = rsa.generate_private_key(\n    65537,\n    key_size=1024)\n",
        "pay/id.pub": b"ssh-rsa AAAAB3NzaC1yc2E user@host\n", "pay/key.pem": b"-----BEGIN RSA PRIVATE KEY-----\nQUJD\n-----END RSA PRIVATE KEY-----\n",
        "pay/store.p12": b"\x00\x01", "pay/go.mod": b"module x\nrequire github.com/golang-jwt/jwt v3.2.0\n", "pay/node_modules/x.py": b"import hashlib\nhashlib.md5(b'')\n",
        "web/nginx.conf": b"ssl_protocols TLSv1 TLSv1.2;\nssl_ciphers DES-CBC3-SHA;\n", "web/lib.so": b"\x7fELF" + b"\x00" * 9 + b"OpenSSL 1.1.1k TLSv1.2\x00", "web/lib.dll": b"MZ" + b"\x00" * 9 + b"SSLv3 marker\x00",
        "web/app.jar": b"PK\x03\x04" + b"TLSv1.1 marker\x00", "web/logo.png": b"\x89PNG",
    }
    for name, raw in put.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    manifest = {"estate_id": "e", "applications": [{"app_id": "pay", "name": "Pay", "repositories": ["repositories/pay"], "criticality": "mission-critical", "services": ["pay-api"]}]}
    (tmp_path / "estate.json").write_text(json.dumps(manifest))

    files = route(scan_corpus(spark, str(root)))
    kinds = {r.path: r.kind for r in files.select("path", "kind").collect()}
    assert len(kinds) == len(put) - 1 and kinds["web/logo.png"] == "skipped" and not any("node_modules" in p for p in kinds)
    linkage = spark.createDataFrame([("web/lib.so", "elf", 0, "libcrypto.so.1.1", None)], "file string, fmt string, ord long, soname string, openssl_version string")
    as_of = F.lit("2026-01-15 00:00:00").cast("timestamp")
    found = detect(files, as_of, linkage=linkage).cache()
    rows = found.collect()
    assert {(r.file, r.line, r.key_size) for r in rows if r.detector == "python-ast"} == {("pay/src/keys.py", 4, 1024)}
    assert any(r.file == "pay/id.pub" for r in rows) and any(r.file == "pay/key.pem" and r.key_material_in_repo for r in rows)
    assert any(r.file == "pay/store.p12" for r in rows)
    assert {(r.file, r.language) for r in rows if r.method == "strings"} == {("web/lib.so", "elf"), ("web/lib.dll", "pe")}
    assert [r.library_version for r in rows if r.method == "dynamic-linkage"] == ["1.1.1k"]

    estate = read_estate(spark, str(tmp_path / "estate.json"))
    assert estate.applications.first().owner == "unassigned" and estate.services.first().service == "pay-api"
    decided = Scan(found, estate, as_of).decided.collect()
    weak = [r for r in decided if r.key_size == 1024]
    assert weak and all(r.migration_decision not in (None, "RETAIN") for r in weak)
