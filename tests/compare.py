"""Side-by-side run of a registered query and its DuckDB text on one data folder."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb

ROOT = "/root/testdata"


def duck(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, root, name, fn, sql):
    t = time.time()
    df = fn(spark, root)
    got = df.collect()
    spent = time.time() - t
    mine = rows_of(df.columns, got)
    if sql is None:
        return f"rows-only {len(mine)}", spent, df
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = rows_of(cols, cur.fetchall())
    duck_spent = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", spent, df
    if mine == theirs:
        return f"ok {len(mine)} (duck {duck_spent:.1f}s)", spent, df
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    extra = f"DIFF rows {len(mine)} vs {len(theirs)}, {len(diff)} unequal\n   cols {sorted(cols)}"
    for a, b in diff[:3]:
        extra += f"\n   mine   {a}\n   oracle {b}"
    return extra, spent, df


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from barloom.session import local_session

    sf = argv[0] if argv else "0.001"
    wanted = argv[1:]
    root = f"{ROOT}/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(root)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []

    def one(name):
        try:
            msg, spent, _ = check(spark, con.cursor(), root, name, qs[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            msg, spent = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0
        if not msg.startswith(("ok", "rows-only")):
            bad.append(name)
        print(f"{name:45s} {spent:6.1f}s {msg}", flush=True)

    names = [n for n in qs if not wanted or any(n.startswith(w) for w in wanted)]
    with ThreadPoolExecutor(int(os.environ.get("COMPARE_THREADS", "4"))) as pool:
        list(pool.map(one, names))
    print(f"{len(bad)} bad of {len(names)}: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
