"""Run queries next to their SQL in DuckDB and compare whole results.

usage: python tools/check_oracles.py [--sf DIR] [name ...]
"""

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidepanel.plans import catalog  # noqa: E402
from tidepanel.session import build_session, clear_stages  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
FAMILY = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float"}


def connect(sf):
    con = duckdb.connect()
    con.execute("set threads=8")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def key(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(key(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return str({k: key(x) for k, x in v.asDict().items()})
    return str(v)


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return key(a) == key(b)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(x) for x in df.select(*[f"`{c}`" for c in cols]).collect()]
    spent = time.time() - t0
    if not sql:
        return f"rows-only {len(rows)}", spent, True
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(t).lower() for t in rel.types]))
    if sorted(rel.columns) != cols:
        return f"COLUMNS spark={cols} sql={sorted(rel.columns)}", spent, False
    for c, t in df.dtypes:
        want = {"hugeint": "HUGE"}.get(types[c], FAMILY.get({"integer": "int", "varchar": "string", "boolean": "boolean"}.get(types[c], types[c]), types[c]))
        have = FAMILY.get(t, t)
        ok = have == want or (have == "string" and types[c] == "varchar") or types[c].endswith("[]") or types[c].startswith("timestamp") or types[c].startswith("struct")
        if not ok:
            return f"TYPE {c}: spark={t} sql={types[c]}", spent, False
    other = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})").fetchall()
    if len(rows) != len(other):
        return f"ROWS spark={len(rows)} sql={len(other)}", spent, False
    a = sorted(rows, key=lambda x: [key(v) for v in x])
    b = sorted(other, key=lambda x: [key(v) for v in x])
    exact = sum(1 for x, y in zip(a, b) if [key(v) for v in x] != [key(v) for v in y])
    if exact == 0:
        return f"ok {len(rows)}", spent, True
    sa, sb = set(map(lambda x: tuple(key(v) for v in x), a)), set(map(lambda x: tuple(key(v) for v in x), b))
    da, db = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
    near = all(all(close(u, v) for u, v in zip(x, y)) for x, y in zip(a, b))
    return f"VALUES {len(sa - sb)} of {len(rows)} differ near={near}\n    cols {cols}\n    spark {da}\n    sql   {db}", spent, False


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    spark = build_session("check", "local[8]", 8, {"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(a.sf)
    qs, sqls = catalog.queries(), catalog.oracles()
    names = a.names or list(qs)
    bad = 0
    for n in [x for x in qs if any(x == y or (y.endswith("*") and x.startswith(y[:-1])) for y in names)]:
        try:
            msg, spent, ok = compare(spark, con, a.sf, n, qs[n], sqls.get(n))
        except Exception as e:  # report and go on with the next query
            msg, spent, ok = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0.0, False
        clear_stages(spark)
        bad += not ok
        print(f"{'  ' if ok else '! '}{n:34s} {spent:6.2f}s {msg}", flush=True)
    print(f"{bad} failing of {len(names)}")


if __name__ == "__main__":
    main()
