"""The derived corpus made from distinct keys, and detectors that look at their own files."""

from pyspark.sql import functions as F

from cipherledger.operators import containers, lexical
from cipherledger.sources import driver_text as tx

SF = "/root/testdata/sf0.001"


def test_corpus_of_odd_rows(spark, tmp_path):
    lines, parts = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "part"))
    some = lines.orderBy("l_orderkey", "l_linenumber").limit(300).localCheckpoint()
    odd = [some, some.limit(40), *[some.limit(60).withColumn(k, F.lit(None).cast(some.schema[k].dataType)) for k in tx.FILE_KEYS],
           some.limit(60).withColumn("l_orderkey", -F.col("l_orderkey"))]
    whole = odd[0]
    for d in odd[1:]:
        whole = whole.unionByName(d)
    whole.write.parquet(f"{tmp_path}/lineitem.parquet")
    first = parts.where("p_partkey % 3 = 0")
    twice = first.withColumn("p_size", F.col("p_size") + 1).unionByName(first.withColumn("p_size", F.lit(None).cast(first.schema["p_size"].dataType)))
    parts.unionByName(first).unionByName(twice).write.parquet(f"{tmp_path}/part.parquet")
    got = tx.text_files(spark, str(tmp_path))
    from cipherledger.knowledge import algorithms as kb
    from cipherledger.knowledge.tables import dimension
    l, p = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("lineitem", "part"))
    want = (l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(dimension(spark, kb.kb_rows(), kb.KB_COLUMNS), F.expr("l_partkey % 48 = kb_ord"))
            .selectExpr(*[f"{e} AS {n}" for n, e in tx.FILE_SQL.items()]).distinct())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_every_marker_holds_one_of_its_words(spark):
    samples = ["Cipher.getInstance (", "MESSAGEDIGEST.getInstance(", "Signature.getInstance(", "KeyPairGenerator.getInstance(", "KeyAgreement.getInstance(",
               "Mac.getInstance(", "SecretKeyFactory.getInstance(", "crypto.createDecipheriv(", "crypto.createHash(", "crypto.createHmac(", "crypto.sign(",
               "crypto.generateKeyPairSync(", "createECDH(", "EVP_DecryptInit_ex2(", "EVP_DigestVerifyFinal(", "EVP_PKEY_derive_x(", "RSA_sign(",
               "SSL_CTX_set1_groups(", "ecdsa.Verify(", "cipher.NewGCM(", "curve25519.X", "hashlib.sha3_256(", "hmac.new(", "x.verify(", "x.sign(",
               "generate_private_key(", "exchange(", "decapsulate("]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, text string").withColumn("low", F.lower("text"))
    got = {r.i: r.label for r in rows.select("i", lexical.api_marker(F.col("text"))["label"].alias("label")).collect()}
    assert got == {i: label for i, (_, label, _) in enumerate(lexical.APIS)}
    assert len(lexical.API_WORDS) == len(lexical.APIS) and all(lexical.alternative_words(rx) for rx, _ in lexical.TOKENS)


def test_facts_of_containers_are_found_once(spark):
    files = spark.createDataFrame([("a/Dockerfile", "FROM nginx\nENV TLS_MIN=1.2"), ("a/x.py", "FROM nginx")], "path string, text string")
    out = containers.container_detections(files)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.file for r in out.collect()} == {"a/Dockerfile"} and "container-facts" in "".join(out.inputFiles()) and "regexp_extract_all" not in plan
