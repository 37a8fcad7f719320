"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from waymark.plans.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else v)
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    return table_of([d[0] for d in cur.description], cur.fetchall())


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    got = spark_rows(fn(spark, sf_dir))
    took = time.time() - start
    if sql is None:
        return True, f"{name}: rows only, {len(got[1])} rows, {took:.2f}s"
    want = sql_rows(con, sql)
    if got == want:
        return True, f"{name}: ok, {len(got[1])} rows, {took:.2f}s"
    detail = [f"{name}: MISMATCH spark {len(got[1])} rows, sql {len(want[1])} rows; {got[0]} / {want[0]}"]
    if got[0] == want[0]:
        a, b = set(got[1]), set(want[1])
        detail += [f"  only spark: {sorted(a - b)[:3]}", f"  only sql: {sorted(b - a)[:3]}"]
    return False, "\n".join(detail)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from waymark.session import local_session

    sf = sys.argv[1]
    words = sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad, empty = [], []
    for name in queries:
        if words and not any(name.startswith(w) for w in words):
            continue
        try:
            ok, text = compare(spark, con, sf, name, queries[name], sql.get(name))
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{name}: ERROR {type(error).__name__} {str(error)[:600]}"
        print(text, flush=True)
        if not ok:
            bad.append(name)
        elif " 0 rows" in text:
            empty.append(name)
    print(f"{len(bad)} failed: {bad}; empty: {empty}")
