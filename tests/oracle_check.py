"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's check: same column names, same row count, equal values
after sorting columns by name and rows by all values.
Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from faultlens.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def frame_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(x) for x in rec))
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    dd = con.execute(sql).fetchdf()
    res = {"name": name, "spark_s": round(t1 - t0, 2), "rows": len(sp)}
    if sorted(sp.columns) != sorted(dd.columns):
        res["ok"] = False
        res["why"] = f"columns {sorted(sp.columns)} vs {sorted(dd.columns)}"
        return res
    if len(sp) != len(dd):
        res["ok"] = False
        res["why"] = f"rows {len(sp)} vs {len(dd)}"
        return res
    a, b = frame_rows(sp), frame_rows(dd)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    res["ok"] = not bad
    if bad:
        res["why"] = f"{len(bad)} differing rows, e.g. {bad[0]}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    from faultlens.session import local_session
    import __spark_entry__ as E
    spark = local_session(8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        if name not in os_:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            r = compare(spark, con, name, fn, os_[name], sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:300]}"}
        fails += not r["ok"]
        print(("OK    " if r["ok"] else "FAIL  ") + name, r.get("rows"), r.get("spark_s"), r.get("why", ""),
              flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
