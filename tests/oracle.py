"""Side-by-side check of registered queries against their SQL counterparts in DuckDB.

python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, bool):
        return str(v)
    return "NULL" if v is None else str(v)


def _close(x, y) -> bool:
    """Equal up to one unit of the rounding both sides apply (a sum that lands on a rounding edge)."""
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)
    return _norm(x) == _norm(y)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, edges: bool = False):
    """None when equal, else a short description of the difference. ``edges`` forgives a last rounded digit."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(set(spark_cols) ^ set(duck_cols))}"
    si = [spark_cols.index(c) for c in sorted(spark_cols)]
    di = [duck_cols.index(c) for c in sorted(duck_cols)]
    a = sorted(tuple(_norm(r[i]) for i in si) for r in spark_rows)
    b = sorted(tuple(_norm(r[i]) for i in di) for r in duck_rows)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad and edges:
        key = lambda r: [f"{v:.4g}" if isinstance(v, float) else _norm(v) for v in r]
        sides = [sorted((tuple(r[i] for i in ix) for r in rows), key=key) for rows, ix in ((spark_rows, si), (duck_rows, di))]
        bad = [(x, y) for x, y in zip(*sides) if not all(_close(u, v) for u, v in zip(x, y))]
    return None if not bad else f"{len(bad)}/{len(a)} rows differ ({sorted(spark_cols)}): {bad[0]}"


def check(spark, con, sf: str, name: str, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(rows)}", t1 - t0, 0.0, len(rows)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    return compare(rows, df.columns, want, cols), t1 - t0, time.time() - t1, len(rows)


def main() -> int:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from barspark.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark, con = get_spark(), duck(sf)
    qs, sq = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        try:
            res, ts, td, n = check(spark, con, sf, name, fn, sq.get(name))
        except Exception as e:  # keep going: report every failure of a run
            res, ts, td, n = f"ERROR {str(e)[:600]}", 0.0, 0.0, 0
        ok = res is None or res.startswith("rows-only")
        fails += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} n={n:<7d} spark={ts:5.2f}s sql={td:5.2f}s {res or ''}"[:1000], flush=True)
    print(f"{fails} failures")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main())
