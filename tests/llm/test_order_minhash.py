"""Order MinHash against a plain form of its definition."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherledger.llm import order_minhash as o
from cipherledger.llm import registry


def edit(text, following):
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def test_numbered_kmers():
    hashes, place = o.numbered_kmers(o.code_points("abababab"), 2)
    by_place = dict(zip(place.tolist(), hashes.tolist()))
    assert sorted(by_place) == list(range(7)) and len(set(by_place.values())) == 7  # repeats are told apart
    other, where = o.numbered_kmers(o.code_points("xxab"), 2)
    assert dict(zip(where.tolist(), other.tolist()))[2] == by_place[0]  # a first occurrence anywhere is the same
    for k in (1, 3, 5, 8, 13):
        assert len(o.numbered_kmers(o.code_points("some longer text"), k)[0]) == max(1, 16 - k + 1)


def test_slots_follow_the_definition():
    text = "the quick brown fox jumps over the lazy dog, the quick brown fox sleeps " * 5
    kmers, place = o.numbered_kmers(o.code_points(text))
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    factors, offsets = o._functions(o.SLOTS // 2)
    want = []
    for slot in range(o.SLOTS):
        h = (short ^ offsets[slot // 2]) * factors[slot // 2]
        least = np.argsort(~h if slot % 2 else h, kind="stable")[:o.TUPLE]
        code = np.zeros(1, np.uint64)
        for at in sorted(least.tolist(), key=lambda i: place[i]):
            code = o._mixed(code * o._MIX + kmers[at:at + 1])
        want.append(int(code[0] >> np.uint64(48)))
    assert o.fingerprint(o.code_points(text)).tolist() == want


def test_likeness_follows_edits_and_order():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    like = lambda a, b: float((o.fingerprint(o.code_points(a)) == o.fingerprint(o.code_points(b))).mean())
    text = " ".join(words)
    assert like(text, text) == 1
    assert like(text, text.replace(words[7], "other")) > .8
    swapped = " ".join(words[200:] + words[:200])  # the same k-mers but for the seam, in another order
    assert .3 < like(text, swapped) < .75
    assert like(text, " ".join(reversed(words))) < .1


@pytest.mark.parametrize("range_bytes", [16_000_000, 2_000])
def test_successors_over_ranges(spark, range_bytes):
    texts = {i * 3: ("text %d " % (i % 37)) * (i % 50) for i in range(200)} | {1: None, 4: "", 7: "short", 1000: "é😀" * 4000}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = {r.doc_id: r for r in o.with_edits(df, range_bytes=range_bytes).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b, r = texts[i] or "", texts[j] or "", got[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edit(a, b).encode()).hexdigest()
        assert r.fingerprint == o._hex(o.fingerprint(o.code_points(a))) and r.edited_fingerprint == o._hex(o.fingerprint(o.code_points(edit(a, b))))
        assert r.near_next == float((o.fingerprint(o.code_points(a)) == o.fingerprint(o.code_points(b))).mean())
    plain = {r.doc_id: r.fingerprint for r in o.fingerprints(df).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    near = df.select("doc_id", "text").join(o.fingerprints(df), "doc_id").select("doc_id", o.likeness(F.col("fingerprint"), F.col("fingerprint")).alias("x"))
    assert {r.x for r in near.collect()} == {1.0}


def test_few_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (5, "b c"), (5, "b c"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_chars) for r in o.with_edits(df).collect()) == [(-1, 1), (5, 0), (5, 3), (5, 3)]
    assert o.with_edits(df.limit(0)).collect() == []
    assert o.with_edits(df.limit(1)).count() == 1


def test_query_covers_the_table(spark):
    assert registry.QUERIES["op5_order_minhash"](spark, "/root/testdata/sf0.001").count() == 200
