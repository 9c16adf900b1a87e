"""Int8 tile products against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherledger.llm import vectors as v


def planted(rng, n, d=24):
    base = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(1, n):
        kind = rng.random()
        if kind < .3:  # around the threshold
            base[i] = base[rng.integers(i)] + rng.normal(size=d) * rng.uniform(.2, .5)
        elif kind < .45:
            base[i] = base[rng.integers(i)] * rng.choice([1, 1, 3])
    return base


def slow(rows, threshold=.93):
    def unit(x):
        if x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x):
            return None
        a = np.array(x, np.float64)
        return a / np.sqrt((a * a).sum()) if a.any() else None
    units = [unit(e) if i is not None and l is not None else None for i, e, l in rows]
    links, label = [0] * len(rows), list(range(len(rows)))
    def root(k):
        while label[k] != k:
            k = label[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][2] == rows[b][2] and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a] += 1
                links[b] += 1
                label[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted((r[0] is not None, r[0] or 0, links[k], least[root(k)] if r[0] is not None else None,
                   r[0] is not None and least[root(k)] == r[0]) for k, r in enumerate(rows))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = planted(rng, 300, 64).astype(np.float64)
    parts = v.quantise(x)
    u, q, s, n, e = parts
    exact = u @ u.T
    about = v.tile_products(q, q) * s[:, None] * s[None]
    assert (np.abs(exact - about) <= n[:, None] * e + e[:, None] * n + e[:, None] * e + v.ROUNDING).all()
    assert (v.tile_links(parts, parts, .93) == (exact >= .93)).mean() > .99999


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_links_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 7 % 1009, [float(c) for c in e], int(rng.integers(3))) for i, e in enumerate(planted(rng, 400))]
    rows += [rows[5], rows[5], (2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] * 24, 1), (2004, [], 1),
             (None, rows[0][1], rows[0][2]), (2005, rows[3][1], None), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [float("inf")] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in v.near_duplicates(df, block_rows=block_rows).collect())
    as_float = [(i, None if e is None else [None if c is None else float(np.float32(c)) for c in e], l) for i, e, l in rows]
    assert got == slow(as_float)
    assert v.near_duplicates(df.limit(0)).collect() == []
