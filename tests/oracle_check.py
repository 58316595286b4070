"""Run registered queries against their DuckDB oracle SQL (the driver's
correctness gate, reproduced locally): row count, column names and an
order-insensitive comparison of all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    t2 = time.time()
    s_sorted, s_cols = rows_of(sdf.columns, srows)
    d_sorted, d_cols = rows_of(dcols, drows)
    ok_cols = s_cols == d_cols
    ok_n = len(s_sorted) == len(d_sorted)
    diff = 0
    if ok_cols and ok_n:
        diff = sum(1 for a, b in zip(s_sorted, d_sorted) if a != b)
    status = "OK" if ok_cols and ok_n and diff == 0 else "FAIL"
    msg = f"{status:4} {key:28} rows={len(s_sorted)}/{len(d_sorted)} diff={diff} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if not ok_cols:
        msg += f" cols {s_cols} vs {d_cols}"
    if status == "FAIL" and ok_cols and ok_n:
        for a, b in zip(s_sorted, d_sorted):
            if a != b:
                msg += f"\n      spark {a}\n      duck  {b}"
                break
    return status == "OK", msg


def main(keys=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from plexnet.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for k in (keys or sorted(qs)):
        if k not in sqls:
            t0 = time.time()
            try:
                n = qs[k](spark, sf_dir).count()
                print(f"ROWS {k:28} rows={n} ({time.time() - t0:.1f}s, no oracle)", flush=True)
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERR  {k:28} {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        try:
            ok, msg = compare(spark, con, k, qs[k], sqls[k], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERR  {k:28} {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(msg, flush=True)
    print(f"failed: {bad}")
    return bad


if __name__ == "__main__":
    main(sys.argv[1:] or None)
