"""Run every registered query against its DuckDB oracle (as the driver does).

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: ok / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(records, cols):
    out = []
    for r in records:
        out.append(tuple(_norm(r[c]) for c in cols))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    from speclab.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            srows = [r.asDict() for r in sdf.collect()]
            scols = sorted(sdf.columns)
            dt = time.time() - t0
            if name not in sqls:
                print(f"rows-only {name}: {len(srows)} rows {dt:.1f}s")
                continue
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = [dict(zip(dcols, r)) for r in res.fetchall()]
            if sorted(dcols) != scols:
                bad += 1
                print(f"MISMATCH cols {name}: spark={scols} duck={sorted(dcols)}")
                continue
            a, b = rows_of(srows, scols), rows_of(drows, scols)
            if a == b:
                print(f"ok {name}: {len(a)} rows {dt:.1f}s")
            else:
                bad += 1
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print(f"MISMATCH {name}: spark={len(a)} duck={len(b)} first diffs={diff}")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:400]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
