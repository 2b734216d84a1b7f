"""Compare registered Spark queries with their DuckDB oracle.

Usage: ``python -m parity.check [sf_dir] [name-substring ...]``. For each
key: row counts, column names, and an order-insensitive comparison of all
values (columns sorted by name, rows sorted by their repr). Prints one line
per key and exits non-zero on any mismatch.
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in DRIVER_VIEWS:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v else "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def spark_rows(df):
    rows = df.collect()
    return df.columns, [tuple(r) for r in rows]


def oracle_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, con, sf_dir, name, fn, sql) -> tuple[bool, str]:
    t0 = time.time()
    scols, srows = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(srows)} spark={t1 - t0:.2f}s"
    ocols, orows = oracle_rows(con, sql)
    sc, sr = canon(scols, srows)
    oc, orr = canon(ocols, orows)
    if sc != oc:
        return False, f"columns differ spark={sc} oracle={oc}"
    if len(sr) != len(orr):
        return False, f"row count spark={len(sr)} oracle={len(orr)}"
    if sr != orr:
        diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
        return False, f"values differ ({len(sr)} rows), first: {diff}"
    return True, f"{len(sr)} rows spark={t1 - t0:.2f}s"


def main(argv: list[str]) -> int:
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from parity.registry import load_all
    REGISTRY = load_all()
    from rosterlake.plans.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, sql)
        except Exception as e:  # report and continue with the next key
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name}: {msg}", flush=True)
    print(f"{bad} mismatches")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
