"""Run registered queries next to their SQL on the same tables and compare values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(con, spark, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows-only ({len(got)} rows)"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns differ: {got_cols} != {want_cols}"
    if got == want:
        return True, f"{len(got)} rows"
    gs, ws = set(map(str, got)), set(map(str, want))
    diff = [f"{len(got)} vs {len(want)} rows; only ours {len(gs - ws)}, only sql {len(ws - gs)}"]
    diff += ["  ours " + x[:400] for x in sorted(gs - ws)[:3]] + ["  sql  " + x[:400] for x in sorted(ws - gs)[:3]]
    return False, f"{got_cols}\n" + "\n".join(diff)


def main():
    import __spark_entry__ as entry
    from cipherledger.session import local_session
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if len(args) > 1 and not any(name.startswith(a) for a in args[1:]):
            continue
        t = time.time()
        try:
            ok, note = compare(con, spark, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
