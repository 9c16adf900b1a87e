"""Periodic runs against brute force, on hostile small sequences and on the whole table."""

import hashlib
import random
import re
import zlib

import numpy as np

from cipherledger.llm import periodic_runs, registry

SF = "/root/testdata/sf0.001"


def slow_runs(w, least=6, periods=4):
    """Maximal stretches of equal distance for every period, kept if no smaller one fits."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[s:i + q]
            if len(part) >= max(least, periods * q) and not any(part[:-k] == part[k:] for k in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_transform_is_the_exact_correlation():
    rng = np.random.default_rng(2)
    for n in (2, 64, 128, 4096, 8192):
        a, b = rng.integers(0, periodic_runs.PRIME, (2, 3, n))
        product = periodic_runs.transform(a.astype(float), n) * periodic_runs.transform(b.astype(float), n)
        got = periodic_runs.transform(periodic_runs._mod(product), n, inverse=True)
        k = int(rng.integers(n))  # one place of the cyclic convolution, in whole numbers
        want = [sum(int(x) * int(y) for x, y in zip(p, np.roll(q[::-1], k + 1))) * n % periodic_runs.PRIME for p, q in zip(a, b)]
        assert got[:, k].tolist() == want


def test_hostile_sequences_against_brute_force():
    rng = random.Random(5)
    texts = []
    for _ in range(300):  # few different words, periodic parts of any period, with and without flaws
        words = []
        while len(words) < rng.choice((5, 40, 200)):
            unit = [rng.choice("abc") for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13, 24)))]
            words += (unit * rng.randrange(1, 9))[:rng.randrange(1, 60)]
            if rng.random() < .3:
                words.append(rng.choice("abcxyz"))
        texts.append(words)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts += [list(fibonacci[-1]), list("a" * 700), list(("a" * 30 + "x") * 20), list("ab" * 300 + "b" + "ab" * 300), [], ["a"], list("aaaaa"), list("aaaaaa"),
              [str(k % 170) for k in range(900)], [str(k % 170) for k in range(679)]]
    for small_blocks in (periodic_runs.MAX_BLOCK, 4):
        order = sorted(texts, key=len, reverse=True)
        codes = {}
        sequence, lengths = [], np.array([len(t) for t in order])
        for k, t in enumerate(order):
            sequence += [codes.setdefault(w, len(codes)) for w in t] + [10_000 + k]
        got = periodic_runs.find(np.array(sequence), lengths, max_block=small_blocks).tolist()
        want, at = [], 0
        for t in order:
            want += [[at + s, at + s + l, q] for s, l, q in slow_runs(t)]
            at += len(t) + 1
        assert sorted(got) == sorted(want)


def test_registered_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = [r for r in docs if len(r.text) < 40_000]
    got = {r.doc_id: tuple(r) for r in registry.QUERIES["op12_periodic_runs"](spark, SF).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert len(got) == len(docs) and len(short) > 150
    assert [got[r.doc_id] for r in short] == [slow_row(r.doc_id, r.text) for r in short]
    assert sum(g[1] > 0 for g in got.values()) > 10


def test_long_texts_and_defined_cases(spark):
    long = [str(k * k % 9973) for k in range(5_000)]
    texts = ["", None, " \n ", "a b " * 3, "a b " * 9 + "c " + "a b " * 9, "one two three " * 3, "x y " * 8, " ".join(long * 5), "same " * 200_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a " * 9), (3, "a b " * 3)]
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id long, text string, start int, runs int")
    out = periodic_runs.collapse(df, batch_words=10)
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    for k, t in rows[:7]:
        words = (t or "").encode().split()
        runs = slow_runs(words)
        assert got[k, len(words)][0] == runs
    assert got[7, 25_000] == ([(0, 25_000, 5_000)], " ".join(long))
    assert got[8, 200_000] == ([(0, 200_000, 1)], "same")
    assert got[None, 9] == ([(0, 9, 1)], "a")
    assert out.count() == len(rows)
    assert periodic_runs.digests(periodic_runs.collapse(df.limit(0))).collect() == []
