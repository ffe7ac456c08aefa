"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: (
        "null" if v is None or (isinstance(v, float) and math.isnan(v))
        else f"{v:.6f}" if isinstance(v, float) else str(v)
    )
    return sorted(tuple(fix(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """(equal, rows, message)"""
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    expect, ecols = cur.fetchall(), [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(ecols):
        return False, len(rows), f"columns {sorted(df.columns)} / {sorted(ecols)}"
    got, want = canon(rows, df.columns), canon(expect, ecols)
    if got == want:
        return True, len(rows), ""
    gs, ws = set(got), set(want)
    return False, len(rows), f"rows {len(got)} / {len(want)}; only ours {sorted(gs - ws)[:4]}; only sql {sorted(ws - gs)[:4]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = make_session(), connect(sf_dir), []
    oracle = oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(name == w or name.startswith(w + "_") for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                df = fn(spark, sf_dir)
                ok, n, msg = compare(df, con, oracle[name])
            else:
                n, ok, msg = fn(spark, sf_dir).count(), True, "(rows only)"
        except Exception as e:  # report and go on
            ok, n, msg = False, 0, f"{type(e).__name__}: {str(e)[:900]}"
        if not ok or n == 0:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {n:8d} rows {time.time() - t0:6.1f}s {msg}", flush=True)
    print("failed:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
