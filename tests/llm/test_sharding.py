"""Shards of near-equal bytes, gapless slots and defined cases."""

import zlib

import pytest
from pyspark.sql import functions as F

from cipherledger.llm import sharding


@pytest.mark.parametrize("numbered_rows", [50_000, 20])
def test_law_and_slots(spark, numbered_rows):
    texts = ["short", "", None, "é" * 300] + ["word " * (1 + i * 37 % 211) for i in range(60)]
    rows = [(i, texts[i % len(texts)], "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 7}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash"))
    out = sharding.shard(df, numbered_rows=numbered_rows).collect()
    assert sorted(r.doc_id for r in out) == list(range(6000))
    by = {}
    for r in out:
        raw = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(40))
    sizes = [sum(r.size for r in s) for s in by.values()]
    target = sum(sizes) / 40
    assert max(abs(s - target) for s in sizes) < .03 * target + max(r.size for r in out)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())


def test_few_equal_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "same", "en", "s"), (1, "same", "en", "s"), (2, "same", "en", "s")], "doc_id long, text string, lang string, source string")
    out = sharding.shard(df).collect()
    assert len(out) == 4 and all(0 <= r.shard < 40 for r in out)
    assert len({(r.shard, r.slot) for r in out}) == 4
    assert sharding.shard(df.limit(0)).collect() == []
    assert len(sharding.shard(df.select("doc_id", "text")).collect()) == 4
