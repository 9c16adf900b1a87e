"""Revisit resolution against a plain loop and SQL."""

import random

from pyspark.sql import functions as F

from cipherledger.llm import registry, warc
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def slow(rows):
    out = []
    for rid, kind, url, at, h in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (h or {}).items()}
        best = max(((a, i, g) for i, k, u, a, g in rows if k == "response" and u == url and u is not None and None not in (a, at) and a < at), key=lambda x: x[:2], default=None)
        if not best:
            out.append((rid, "no_earlier_response", None, None))
            continue
        g = {k.lower(): v for k, v in (best[2] or {}).items()}
        cut = lambda t: t.removeprefix("W/")
        ok = cut(g["etag"]) == cut(h["etag"]) if "etag" in g and "etag" in h else g["last-modified"] == h["last-modified"] if "last-modified" in g and "last-modified" in h else None
        new = {**g, **{k: v for k, v in h.items() if k not in warc.KEPT_FIELDS}} if ok else None
        out.append((rid, "resolved" if ok else "no_validator" if ok is None else "validator_mismatch", best[1], new))
    return sorted(out, key=str)


def test_asof_validators_and_headers(spark):
    rng = random.Random(3)
    urls = ["http://a.org/x"] * 6 + ["http://a.org/y", "http://b.org", None]
    rows = []
    for i in range(500):
        h = rng.choice([None, {}, {"ETag": f'"{rng.randrange(3)}"'}, {"etag": f'W/"{rng.randrange(3)}"', "Content-Length": str(i)}, {"Last-Modified": str(rng.randrange(2)), "Age": str(i)},
                        {"ETag": '"1"', "Last-Modified": "1", "Content-Type": f"t{i}", "Server": str(i)}])
        rows.append((f"{i:04d}", rng.choice(["response", "revisit", "revisit", "request"]), rng.choice(urls), rng.choice([None, *[rng.randrange(3000)] * 20]), h))
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, at long, headers map<string,string>").withColumn("bucket", F.lit("clash"))
    for seconds in (100, 86_400):
        got = sorted(((r.record_id, r.status, r.response_id, r.headers) for r in warc.resolve(df, seconds).collect()), key=str)
        assert [(a, b, c, sorted(d.items()) if d else d) for a, b, c, d in got] == [(a, b, c, sorted(d.items()) if d else d) for a, b, c, d in slow(rows)]
    assert warc.resolve(df.limit(0)).collect() == []


def test_canonical_urls(spark):
    cases = {"HTTP://A.org:80/x/?b=2&utm_source=f&a=1#f": "http://a.org/x?a=1&b=2", "https://a.org:443": "https://a.org", "https://a.org:80/": "https://a.org:80",
             "http://a.org/X?ref=1": "http://a.org/X", "http://a.org/?": "http://a.org", "": "", "nothing": ""}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.c for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).collect()} == cases


def test_query_matches_sql(spark):
    ok, note = compare(connect(SF), spark, SF, "op8_revisits", registry.QUERIES["op8_revisits"], registry.ORACLES["op8_revisits"])
    assert ok, note
