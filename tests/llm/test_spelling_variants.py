"""Spelling variants against brute force: all pairs of words, by deletion and replacement."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cipherledger.llm import registry, spelling_variants

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows, one_in):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % one_in == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def slow_variants(counts):
    shorter = defaultdict(set)  # by a word with one letter cut out: the place and the word
    for w in counts:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1:]].add((i, w))
    near = defaultdict(set)
    for cut, hits in shorter.items():
        for i, a in hits:
            if cut in counts:
                near[a].add(cut)
                near[cut].add(a)
            for j, b in hits:
                if a != b and i == j:
                    near[a].add(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_registered_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = slow_variants(slow_counts([(r.doc_id, r.text) for r in docs], 199))
    got = rows_of(registry.QUERIES["op13_spelling_variants"](spark, SF))
    assert got == want and sum(r[4] > 0 for r in want) > 20


def test_dense_neighbourhoods_and_defined_cases(spark):
    rng = random.Random(6)
    vocabulary = {"".join(rng.choice("aaab") for _ in range(rng.randrange(6, 11))) for _ in range(250)}  # nearly all bigrams are shared
    for word in ("colour", "spelling", "variant", "straße", "naïveté", "ÀÉÎõüÿ", "aaaaaaa", "abababab"):
        vocabulary |= {word, word[1:] + "q", word[:3] + word[4:], word[:2] + "zz" + word[2:], word + "s"}
    often = [rng.choice((1, 8, 64)) for _ in vocabulary]
    rows = [(k, " ".join(rng.choices(sorted(vocabulary), often, k=90)) + ", colour; COLOUR colours×colour 12spelling") for k in range(300)]
    rows += [(None, "spelling variant"), (1, None), (2, ""), (3, "colour " * 2000), (3, "colour " * 2000), (4, "a1b2")]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, word string, n int")
    for one_in in (199, 3):
        want = slow_variants(slow_counts(rows, one_in))
        assert rows_of(spelling_variants.variants(df, one_in=one_in)) == want
        assert sum(r[1] is not None for r in want) > 5
    assert any(form and form != root for _, form, root, *_ in want)  # a chain of forms
    assert spelling_variants.variants(df.limit(0)).collect() == []


def test_pivots_are_the_lightest_disjoint_pair(spark):
    rng = random.Random(7)
    cases = [[(rng.randrange(1, 9), at, f"g{at}") for at in sorted(rng.sample(range(1, 12), rng.randrange(3, 7)))] for _ in range(60)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, prefix array<struct<n:bigint,at:int,gram:string>>")
    for r in df.select("k", spelling_variants.pivots(F.col("prefix")).alias("p")).collect():
        (n, a, _), (m, b, _) = r.p
        assert b - a >= 2 and n + m == min(x[0] + y[0] for x in cases[r.k] for y in cases[r.k] if y[1] - x[1] >= 2)
