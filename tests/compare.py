"""Run queries on Spark and their SQL on DuckDB, and compare all values."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set threads to 8")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(repr(round(v, 9))) + 0.0
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(canon(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name, run, sql, sf_dir):
    t = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return f"rows-only ({len(got[1])} rows)", spent, len(got[1]) > 0
    t = time.time()
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    duck = time.time() - t
    if got[0] != want[0]:
        return f"columns differ: {got[0]} / {want[0]}", spent, False
    if len(got[1]) != len(want[1]):
        return f"row counts differ: {len(got[1])} / {len(want[1])}; {list(set(got[1]) - set(want[1]))[:2]} / {list(set(want[1]) - set(got[1]))[:2]}", spent, False
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ: {bad[:2]}", spent, False
    return f"ok ({len(got[1])} rows, duckdb {duck:.1f}s)", spent, True


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as e
    from dendrospark.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    oracle = e.oracle_sql()
    failed = 0
    total = 0.0
    for name, run in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            message, spent, good = compare(spark, con, name, run, oracle.get(name), sf_dir)
        except Exception as ex:  # report and go on
            message, spent, good = f"{type(ex).__name__}: {str(ex)[:1500]}", 0.0, False
        failed += not good
        total += spent
        print(f"{'PASS' if good else 'FAIL'} {name} {spent:.1f}s {message}", flush=True)
    print(f"failed {failed}, {total:.0f}s in Spark")
