"""Fan-out over the derived tables: counts of the binary rows from the part keys alone."""

import __spark_entry__ as entry
from cipherledger.operators import detect
from cipherledger.plans import registry_text
from cipherledger.sources import driver_tables as dt
from cipherledger.sources import files as fs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_binary_rows_are_counted(spark):
    keys = [r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    rows = entry.queries()["fan_out_detections"](spark, SF).collect()
    got = {(r.detector, r.method, r.confidence): r.n for r in rows}
    assert {k: n for k, n in got.items() if k[0] == "binary-format"} == {
        ("binary-format", "dynamic-linkage", "high"): sum(k % 6 != 3 for k in keys),
        ("binary-format", "symbol-table", "medium"): sum(k % 8 != 6 for k in keys),
        ("binary-format", "strings", "low"): sum((2, 1, 0, 1, 0)[k % 5] for k in keys)}


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_facts_come_from_one_scan(spark):
    routed = fs.routed_text(registry_text.files(spark, SF))
    assert scans(routed) == 1 and scans(detect.file_facts(routed)) == 1
    facts = detect.Facts(routed)
    whole = facts.detections(F.lit(dt.AS_OF).cast("timestamp"))
    # what the detectors read after that are facts and fixed rows
    assert not set(whole.inputFiles()) & set(routed.inputFiles())


def test_counters_equal_a_recount(spark):
    """Counters of the scan next to a recount in plain Python over files of all kinds."""
    docker = "FROM nginx\nRUN pip install paramiko==2.0\nCOPY a.key /k/\n"
    put = {"a/x.py": "import hashlib\nhashlib.md5(b)\nhashlib.sha1(c)\n", "a/Dockerfile": docker, "b/Dockerfile": "# nothing\n", "a/requirements.txt": "cryptography==1.0\nrequests\n",
           "a/k.pem": "-----BEGIN RSA PRIVATE KEY-----\nQUI=\n-----END RSA PRIVATE KEY-----\n", "a/c.pem": "-----BEGIN CERTIFICATE-----\nQUI=\n-----END CERTIFICATE-----\n" * 2,
           "a/s.p12": "x", "a/app.conf": "ssl_protocols TLSv1.2;\n", "a/logo.png": "x", "a/y.zzz": "x", "a/z.go": "a\0b", "a/Cargo.toml": "[dependencies]\nring = \"0.1\"\n", "a/pyconfig.py": "x = 1\n"}
    rows = [(p, t) for p, t in put.items()]
    facts = detect.Facts(fs.routed_text(spark.createDataFrame(rows, "path string, text string")))
    detections = facts.detections(F.lit(dt.AS_OF).cast("timestamp"))
    got = {(r.counter, r.name): r.n for r in facts.coverage(detections).collect()}
    found = detections.collect()
    skipped = {"a/logo.png": "ignored-extension", "a/y.zzz": "unknown-extension", "a/z.go": "binary-content"}
    want = {("scan", "files_seen"): len(put), ("scan", "files_analyzed"): len(put) - 3, ("scan", "skipped_files"): 3, ("scan", "manifests"): 2, ("scan", "configs"): 2, ("scan", "binaries"): 0,
            ("scan", "bytes_analyzed"): sum(len(t) for p, t in put.items() if p != "a/logo.png"), ("scan", "certificates"): 2, ("scan", "private_keys"): 1, ("scan", "key_containers"): 1,
            ("scan", "declared_packages"): 3, ("scan", "calls"): 2, ("scan", "containers"): len({r.file for r in found if r.detector == "container"}),
            ("scan", "dependencies"): sum(r.detector == "dependency-manifest" for r in found), ("language", "python"): 2, ("language", "config"): 1, ("language", "toml"): 1,
            **{("skipped", r): 1 for r in skipped.values()}, **{("detector", d): sum(r.detector == d for r in found) for d in {r.detector for r in found}}}
    assert got == want and got["scan", "containers"] == 1 and got["scan", "dependencies"] >= 1
