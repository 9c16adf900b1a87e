"""Stage semantics on literal rows."""

from pyspark.sql import functions as F

from cipherledger.functions.columns import redact, round_tenth, stable_id
from cipherledger.functions.packages import capability, resolve_package
from cipherledger.operators import (agility, decisions, graph, impact, lexical, normalize,
                                    risk, roadmap, urgency)
from cipherledger.sources.estate import Estate
from cipherledger.sources.files import rekey, route, skipped_folder
from cipherledger.sources.schemas import DETECTION, conform

AS_OF = "2026-01-15 00:00:00"


def detections(spark, rows):
    base = {"file": "a.py", "det_rank": 6, "ord": 0, "sub": 0, "line": 1, "detector": "lexical-context",
            "method": "regex", "confidence": "low"}
    full = [{**base, "ord": i, **r} for i, r in enumerate(rows)]
    names = sorted({k for r in full for k in r})
    schema = ", ".join(f"{n} {DETECTION[n]}" for n in names)
    return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema))


def estate(spark, apps=(), repos=(), services=(), containers=(), certs=(), bins=()):
    a = spark.createDataFrame(
        [(x.get("app_id"), x.get("app_id"), x.get("owner", "team"), x.get("business_unit", "bu"), "production",
          x.get("criticality", "important"), x.get("exposure", "internal"), x.get("classification", "internal"),
          x.get("lifetime", 3), "", x.get("function", ""), "operator-declared", ["PCI"]) for x in apps],
        "app_id string, name string, owner string, business_unit string, environment string, criticality string, "
        "exposure string, data_classification string, data_lifetime_years int, description string, "
        "business_function string, context_source string, regulatory array<string>")
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Estate(a, df(repos, "app_id string, repository string, ord bigint"), df(services, "app_id string, service string"),
                  df(containers, "app_id string, container string, ord bigint"),
                  df(certs, "basename string, app_id string"), df(bins, "basename string, app_id string"))


def assets_of(spark, rows, est=None):
    return normalize.normalize(detections(spark, rows), est or estate(spark))


def decided_of(spark, rows, est=None, policy="nist_general"):
    a = risk.assess(risk.with_policy(assets_of(spark, rows, est), policy))
    a = urgency.apply_scenario(agility.assess_agility(a), F.lit(AS_OF).cast("timestamp"))
    return decisions.decide(a)


def one(df, *cols):
    rows = df.select(*cols).collect()
    assert len(rows) == 1, rows
    return tuple(rows[0])


# --- normalisation ----------------------------------------------------------------------
def test_two_detectors_one_fact(spark):
    a = assets_of(spark, [
        {"file": "s.py", "line": 84, "algorithm": "rsa", "key_size": 2048},
        {"file": "s.py", "line": 84, "algorithm": "rsa", "key_size": 2048, "confidence": "high",
         "method": "ast-call", "detector": "python-ast"}])
    assert one(a, "duplicate_count", "confidence", "asset_name") == (2, "high", "RSA-2048")


def test_parameters_follow_evidence_not_order(spark):
    low = {"algorithm": "rsa", "key_size": 1024}
    high = {"algorithm": "rsa", "key_size": 2048, "confidence": "high"}
    for rows in ([low, high], [high, low]):
        assert one(assets_of(spark, rows), "key_size") == (2048,)


def test_role_conflict_and_default(spark):
    a = assets_of(spark, [{"algorithm": "rsa", "role": "unknown", "confidence": "medium"},
                          {"algorithm": "rsa", "role": "key-transport", "confidence": "high"}])
    assert one(a, "cryptographic_role") == ("key-transport",)
    presence = assets_of(spark, [{"algorithm": "sha-256", "method": "symbol-table", "detector": "binary-format"}])
    assert one(presence, "cryptographic_role", "tags") == ("unknown", ["presence-only-evidence"])


def test_longest_prefix_and_late_binding(spark):
    est = estate(spark, [{"app_id": "outer"}, {"app_id": "inner"}, {"app_id": "pki"}],
                 repos=[("outer", "pay", 0), ("inner", "pay/src", 1)], certs=[("x.crt", "pki")])
    a = assets_of(spark, [{"file": f, "algorithm": "rsa"} for f in ("pay/src/a.py", "pay/b.py", "payment/c.py", "certs/x.crt")], est)
    got = {r["file"]: (r["application"], r["context_source"]) for r in a.collect()}
    assert got == {"pay/src/a.py": ("inner", "operator-declared"), "pay/b.py": ("outer", "operator-declared"),
                   "payment/c.py": (None, "default"), "certs/x.crt": ("pki", "operator-declared")}


def test_stable_id_keeps_nulls_as_empty(spark):
    import hashlib
    got = spark.range(1).select(stable_id("ca", F.lit("a"), F.lit(None), F.lit(3))).first()[0]
    assert got == "ca-" + hashlib.sha256(b"a||3").hexdigest()[:16]


# --- axes -------------------------------------------------------------------------------
def test_axes_are_independent(spark):
    cases = {"md5": ("critical", "info"), "aes-256": ("info", "info"), "ecdsa": ("info", "critical"), "rsa": ("high", "critical")}
    rows = [{"line": i + 1, "algorithm": a, "key_size": {"aes-256": 256, "rsa": 1024}.get(a),
             "curve": "P-384" if a == "ecdsa" else None} for i, a in enumerate(cases)]
    got = {r["algorithm"]: (r["classical_risk"], r["quantum_exposure"]) for r in decided_of(spark, rows).collect()}
    assert got == cases


def test_curve_spelling_and_kdf_halving(spark):
    rows = [{"line": 1, "algorithm": "ecdsa", "curve": "P521"}, {"line": 2, "algorithm": "pbkdf2"}]
    got = {r["algorithm"]: (r["security_strength"], r["quantum_exposure"]) for r in decided_of(spark, rows).collect()}
    assert got == {"ecdsa": (128, "critical"), "pbkdf2": (128, "medium")}


def test_strict_policy_keeps_hash_below_floor(spark):
    d = decided_of(spark, [{"algorithm": "sha-512"}], policy="nsa_cnsa2")
    assert one(d, "classical_risk", "migration_decision") == ("medium", "HARDEN")


def test_rounding_matches_exact_half_even(spark):
    xs = [37.05, 29.25, 48.75, 33.15, 40.95, 2.25, 0.05, 62.35, 99.95, 0.0, 78.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(round_tenth(F.col("x"))).collect()]
    assert got == [round(x, 1) for x in xs]


def test_earlier_horizon_is_never_less_urgent(spark):
    est = estate(spark, [{"app_id": "a", "lifetime": 8}], repos=[("a", "r", 0)])
    a = risk.assess(risk.with_policy(assets_of(spark, [{"file": "r/x.py", "algorithm": "rsa", "role": "digital-signature"}], est)))
    swept = urgency.apply_scenarios(a, urgency.scenario_table(spark), F.lit(AS_OF).cast("timestamp"))
    gaps = [r[0] for r in swept.orderBy("crqc_year").select("mosca_gap_years").collect()]
    assert gaps == sorted(gaps, reverse=True)


def test_decisions(spark):
    rows = [
        {"line": 1, "algorithm": "rsa", "role": "digital-signature"}, {"line": 2, "algorithm": "x25519", "role": "key-establishment", "protocol": "TLS"},
        {"line": 3, "algorithm": "md5"}, {"line": 4, "algorithm": "rsa", "role": "unknown", "method": "ast-call"},
        {"line": 5, "protocol": "TLS", "protocol_version": "1.0"}, {"line": 6, "algorithm": "x25519kyber768draft00"},
        {"line": 7, "library": "paramiko"}]
    got = {r["line"]: (r["migration_decision"], r["recommended_strategy"]) for r in decided_of(spark, rows).collect()}
    assert got == {1: ("PQC-ONLY", "migrate-to-pqc"), 2: ("HYBRID", "migrate-to-pqt-hybrid"), 3: ("UPGRADE", "replace-now-classical"),
                   4: ("HARDEN", "determine-role-then-migrate"), 5: ("UPGRADE", "upgrade-protocol"), 6: ("HYBRID", "re-pin-to-standard"),
                   7: ("UPGRADE", "migrate-to-pqc")}


# --- libraries --------------------------------------------------------------------------
def test_package_resolution_and_capability(spark):
    names = ["OpenSSL", "libssl1.1t64", "golang.org/x/crypto/ssh", "bcprov-foo", "flask", "crypto/tls"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", resolve_package(F.col("n")))
    assert dict(map(tuple, df.collect())) == {"OpenSSL": "openssl", "libssl1.1t64": "openssl", "golang.org/x/crypto/ssh": "go-crypto",
                                              "bcprov-foo": "bouncycastle", "flask": None, "crypto/tls": "go-crypto"}
    v = spark.createDataFrame([("3.10.1",), ("3.4-rc1",), (None,), ("x",)], "v string").select(capability(F.lit("native"), F.lit("3.5"), F.col("v")))
    assert [r[0] for r in v.collect()] == ["native", "provider", "native", "provider"]


# --- text -------------------------------------------------------------------------------
def tokens(spark, line, path="a.java"):
    f = spark.createDataFrame([(path, line)], "path string, text string")
    return {(r["algorithm"], r["matched"], r["confidence"]) for r in lexical.lexical_detections(f).collect()}


def test_tokens_follow_table_order(spark):
    assert {t[0] for t in tokens(spark, "HMAC-SHA256")} == {"sha-256", "hmac-sha256"}
    assert {t[0] for t in tokens(spark, "ML-DSA-65")} == {"dsa", "ml-dsa-65"}
    assert {t[0] for t in tokens(spark, "HMAC_SHA256")} == {"hmac-sha256"}
    assert {t[0] for t in tokens(spark, "AES-256-GCM and AES")} == {"aes-256"} | {"aes-128"} - {"aes-128"}


def test_every_token_passes_prefilter_and_word():
    import re
    samples = {rx: re.sub(r"\[-_ \]\?|\\b|\\\+\?|\?", "", rx.split("|")[0]).strip("()") for rx, _ in lexical.TOKENS}
    for rx, sample in samples.items():
        sample = re.sub(r"\(.*|\[.*", "", sample) or sample
        full = sample if re.search("(?i)" + rx, sample) else None
        if full:
            assert re.search(lexical.PREFILTER, full), rx
            word = lexical.leading_word(rx)
            assert word is None or word in full.upper(), rx


def test_context_confidence(spark):
    assert ("md5", "MD5", "low") in tokens(spark, "// MD5 is old")
    assert ("aes-128", "AES", "high") in tokens(spark, 'Cipher.getInstance("AES/GCM")')
    assert ("md5", "MD5", "low") in tokens(spark, "// cache key\nx = 'MD5'")
    assert ("rsa", "RSA", "low") in tokens(spark, 'see also Signature.getInstance("RSA")')


def test_redaction(spark):
    rows = ["-----begin rsa private key----- AAA", "token='" + "A1" * 25 + "' end", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(redact(F.col("s"))).collect()]
    assert got[0] == "[REDACTED: private key material detected]"
    assert "A1A1" not in got[1]  or got[1].startswith("token=")
    assert len(got[2]) <= 180


def test_routing(spark):
    f = spark.createDataFrame([("a/x.py", 3, b"abc"), ("a/x.png", 3, b"abc"), ("a/go.mod", 3, b"abc"), ("a/y.txt", 3, b"a\x00b"),
                               ("a/big.py", 3 * 2**20, b"abc")], "path string, length bigint, content binary")
    assert {r["path"]: r["kind"] for r in route(f).collect()}["a/big.py"] == "text"  # no ceiling unless one is given
    got = {r["path"]: (r["kind"], r["skip_reason"]) for r in route(f, 2 * 2**20).collect()}
    assert got == {"a/x.py": ("text", None), "a/x.png": ("skipped", "ignored-extension"), "a/go.mod": ("skipped", "unknown-extension"),
                   "a/y.txt": ("skipped", "binary-content"), "a/big.py": ("skipped", "too-large")}
    s = spark.createDataFrame([("x/node_modules/a.js",), ("x/.git/a",), ("x/a.js",)], "p string").select(skipped_folder(F.col("p")), rekey(F.lit("base"), F.col("p")))
    assert [tuple(r) for r in s.collect()] == [(True, "base/x/node_modules/a.js"), (True, "base/x/.git/a"), (False, "base/x/a.js")]


# --- roadmap ----------------------------------------------------------------------------
def hoisted(spark, items, pairs):
    schema = "asset_id string, phase string, library_node string, protocol_node string, is_provider boolean, is_gate boolean, waits boolean"
    df = spark.createDataFrame([(i, p, None, None, False, False, False) for i, p in items], schema)
    pr = spark.createDataFrame(pairs, "asset_id string, prereq_id string")
    return {r["asset_id"]: r["hoisted"] for r in roadmap.hoist(df, pr).collect()}


def test_hoisting_chain_cycle_and_exemption(spark):
    assert hoisted(spark, [("leaf", "PH2"), ("mid", "PH5"), ("root", "PH5")], [("leaf", "mid"), ("mid", "root")]) == {"mid": 2, "root": 2}
    assert hoisted(spark, [("a", "PH3"), ("b", "PH5")], [("a", "b"), ("b", "a")]) == {"a": 3, "b": 3}
    assert hoisted(spark, [("a", "PH1"), ("b", "PH5")], [("a", "b")]) == {"b": 5}


def test_critical_path_survives_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "asset_id string, prereq_id string")
    focus = spark.createDataFrame([("a",)], "asset_id string")
    assert one(impact.critical_paths(pairs, focus), "path", "length") == (["c", "b", "a"], 3)


def test_dropping_shared_resources_collapses_coupling(spark):
    est = estate(spark, [{"app_id": "a"}, {"app_id": "b"}], repos=[("a", "ra", 0), ("b", "rb", 1)], services=[("a", "s1"), ("b", "s2")])
    shared = [{"file": f"{r}/x.py", "algorithm": "rsa", "library": "openssl"} for r in ("ra", "rb")]
    alone = [{k: v for k, v in r.items() if k != "library"} for r in shared]
    for rows, n, siblings in ((shared, 4, 1), (alone, 2, 0)):
        c = graph.with_centrality(assets_of(spark, rows, est), est)
        assert {(r["dependency_centrality"], r["sibling_assets"]) for r in c.collect()} == {(n, siblings)}
