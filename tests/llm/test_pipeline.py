"""The pipeline's stages against brute force on a small corpus."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from cipherledger.llm import mixing, quality
from cipherledger.session import write_stage
from tests.llm.test_near_copies import edited, roots, shingles

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    rng, rows = random.Random(8), spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    long = [r for r in rows if len(r.text.split()) > 60][:20]
    near = []  # copies on both sides of 0.8 beside the table's own
    for k, r in enumerate(long):
        words = r.text.split()
        near.append(r.asDict() | {"doc_id": 10 ** 6 + k, "text": " ".join(edited(words, max(1, len(words) * (k % 4 + 1) // 100), rng))})
    docs = write_stage(spark.createDataFrame([*(r.asDict() for r in rows), *near], spark.read.parquet(f"{SF}/documents.parquet").schema), "fixture")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(write_stage(stage(spark, steps[-1], SF), name))
    assert all(s.columns == docs.columns for s in steps[:-1])
    whole, good, single, mixed, coded = ([r.asDict() for r in s.collect()] for s in steps)

    scores = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, s in scores.items() if s >= .5)
    assert all(r in whole for r in good)

    ordered = sorted(good, key=lambda r: r["doc_id"])
    root = roots([shingles(r["text"]) for r in ordered])
    assert sorted(r["doc_id"] for r in single) == [r["doc_id"] for k, r in enumerate(ordered) if root[k] == k]
    assert {r["doc_id"] for r in ordered} & {r["doc_id"] for r in near} - {r["doc_id"] for r in single}

    rates = mixing.mix(steps[2], labels, corpus_pipeline.TARGETS, budget="good", growth=corpus_pipeline.GROWTH)
    rate = {r.doc_id: r.rate for r in rates.collect()}
    times = Counter(r["doc_id"] for r in mixed)
    assert all(int(rate[i]) <= times[i] <= int(rate[i]) + 1 for i in rate) and set(times) <= set(rate)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], hashlib.sha256(",".join(map(str, library.encode(r["text"]))).encode()).hexdigest()) for r in mixed)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in coded) == want


def test_defined_cases(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "a plain text of several words that goes on for a while. " * 20
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text, "en", "s", 1), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert sorted((r.doc_id or -1) for r in out.collect()) == [1, 3]
    other = "quite another text that shares an id with the first one. " * 20
    mixed = spark.createDataFrame([(1, text, "en", "s", 1), (1, other, "en", "s", 1), (None, other + "x", "en", "s", 1), (None, "alone " * 9, "en", "s", 1)], schema)
    kept = corpus_pipeline.keep_one_of_each_group(spark, mixed, SF).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, "alone " * 9), (1, text), (1, other)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        assert stage(spark, docs, SF).where("doc_id IS NULL").count() <= 1
