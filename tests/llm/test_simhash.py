"""SimHash fingerprints, the Gray-order index and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cipherledger.llm import registry, simhash
from cipherledger.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [w for w in low.translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ") if w]
    grams = [words[i:i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(codes, distance=4):
    label = list(range(len(codes)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def clustered(n, rng):
    centres = [rng.getrandbits(64) for _ in range(n // 20)]
    return [rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) if rng.random() < .7
            else rng.getrandbits(64) for _ in range(n)]


def test_fingerprints_match_the_rule():
    texts = [None, "", " \n\t", "One", "a b c", "A b\x0bC  d", "éÉ ß x y z " * 40, "w " * 900, "x" * 5000 + " y z w q"]
    assert [simhash.fingerprint(t) % (1 << 64) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_gray_index_finds_all_pairs():
    rng = random.Random(5)
    codes = np.array(sorted(set(clustered(900, rng))), np.uint64)
    for nodes in (np.zeros(len(codes), np.int64), np.array([rng.randrange(300) for _ in codes]), np.minimum(np.arange(len(codes)) // 2, 40)):
        order = np.lexsort((simhash.gray_rank(codes), nodes))
        sorted_codes, node = codes[order], nodes[order]
        q, c = simhash.GrayIndex(sorted_codes, node).search(sorted_codes, node, 4)
        want = np.argwhere((np.bitwise_count(sorted_codes[:, None] ^ sorted_codes[None]) <= 4) & (node[:, None] == node[None]))
        assert sorted(zip(q.tolist(), c.tolist())) == [tuple(x) for x in want.tolist()]


def test_links_of_small_nodes_come_through_the_index(monkeypatch):
    searched = []
    search = simhash.GrayIndex.search
    monkeypatch.setattr(simhash.GrayIndex, "search", lambda self, q, n, d: searched.append(len(q)) or search(self, q, n, d))
    codes, node = np.array([5, 4, 31 << 40, 9, 8], np.uint64), np.array([0, 0, 0, 1, 1])
    a, b = simhash.node_links(codes, node, 4)
    assert list(zip(a.tolist(), b.tolist())) == [(4, 5), (8, 9)] and sum(searched) == 5


def test_registered_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in registry.QUERIES["op6_gray_simhash"](spark, SF).collect()}
    ordered = sorted(docs, key=lambda r: r.doc_id)
    codes = [slow_fingerprint(r.text) for r in ordered]
    assert got == {r.doc_id: (codes[k], ordered[root].doc_id) for k, (r, root) in enumerate(zip(ordered, slow_components(codes)))}


@pytest.mark.parametrize("node_rows", [4096, 24])
def test_links_keep_the_components(spark, node_rows):
    rng = random.Random(6)
    hub = rng.getrandbits(64)
    codes = sorted({*clustered(500, rng), *(hub ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(12)), 0, 1, 31})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = {r.node: r.component for r in connected_components(simhash.links(df, node_rows=node_rows)).collect()}
    want = {}
    for i, r in enumerate(slow_components(codes)):
        want.setdefault(r, []).append(signed[i])
    got = {}
    for c in signed:
        got.setdefault(found.get(c, c), []).append(c)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_documents_with_defined_cases(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them today " * 20
    rows = [(5, text), (3, text), (3, text), (9, text + "indeed"), (7, None), (8, ""), (None, text), (11, "other words entirely here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.component_id) for r in out}
    assert {(5, 3), (3, 3), (7, 7), (8, 7), (None, None), (11, 11)} <= got
    near = (slow_fingerprint(text) ^ slow_fingerprint(text + "indeed")).bit_count() <= 4
    assert (9, 3 if near else 9) in got
    assert simhash.near_duplicates(df.limit(0)).collect() == []
