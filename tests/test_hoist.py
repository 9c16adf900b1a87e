"""Hoisting against plain rounds over explicit pairs, and along a very long chain of issuers."""

import random

from cipherledger.operators import roadmap

ITEM = "asset_id string, library_node string, protocol_node string, is_provider boolean, is_gate boolean, waits boolean, phase string"


def slow_hoist(items, issued):
    pairs = {(a[0], b[0]) for a in items for b in items if a[0] != b[0] and (
        a[1] is not None and a[1] == b[1] and b[3] or a[5] and b[4] and a[2] == b[2])} | {p for p in issued}
    n = {i[0]: int(i[6][2:]) for i in items}
    while True:
        after = dict(n)
        for a, b in pairs:
            if a in n and b in n and n[a] > 1 and n[b] > 1:
                after[b] = min(after[b], n[a])
        if after == n:
            return n
        n = after


def test_random_estates(spark):
    rng = random.Random(13)
    for _ in range(3):
        items = [(f"a{k}", rng.choice([None, "l1", "l2", "l3"]), rng.choice([None, "p1", "p2"]), False, False, False, f"PH{rng.choice((1, 2, 3, 4, 5, 5, 5))}") for k in range(60)]
        items = [(i, lib, p, lib is not None and rng.random() < .2, p is not None and rng.random() < .2, False, ph) for i, lib, p, _, _, _, ph in items]
        items = [(i, lib, p, prov, gate, p is not None and not gate, ph) for i, lib, p, prov, gate, _, ph in items]
        issued = {(f"a{rng.randrange(60)}", f"a{rng.randrange(60)}") for _ in range(40)}
        issued = {(a, b) for a, b in issued if a != b}
        got = roadmap.hoist(spark.createDataFrame(items, ITEM), spark.createDataFrame(sorted(issued), "asset_id string, prereq_id string")).collect()
        want = slow_hoist(items, issued)
        assert {r.asset_id: r.hoisted for r in got} == {r.asset_id: want[r.asset_id] for r in got}
        assert {i for i, n in want.items() if n != next(int(x[6][2:]) for x in items if x[0] == i)} <= {r.asset_id for r in got}


def test_ten_thousand_issuers(spark, monkeypatch):
    written = []
    write = roadmap.write_stage
    monkeypatch.setattr(roadmap, "write_stage", lambda df, name: written.append(name) or write(df, name))
    n = 10_000
    items = [(f"c{k:05}", None, None, False, False, False, "PH2" if k == 0 else "PH5") for k in range(n)]
    pairs = [(f"c{k:05}", f"c{k + 1:05}") for k in range(n - 1)]
    got = {r.asset_id: r.hoisted for r in roadmap.hoist(spark.createDataFrame(items, ITEM), spark.createDataFrame(pairs, "asset_id string, prereq_id string")).collect()}
    assert got == {f"c{k:05}": 2 for k in range(1, n)}
    assert written.count("hoist-round") + written.count("hoist-climb") <= 20 and written.count("hoist-jump") <= 15
