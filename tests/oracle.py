"""Compares the queries with their SQL in DuckDB: rows as multisets of strings, columns by name."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = [p.stem for p in Path("/root/testdata/sf0.001").glob("*.parquet")]


def connect(root: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{root}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def differences(spark, con, f, sql: str, root: str) -> str:
    df = f(spark, root)
    names = sorted(df.columns)
    left = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    order = [cols.index(n) for n in names]
    right = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    if left == right:
        return ""
    return f"{sum(left.values())} and {sum(right.values())} rows; only Spark: {list((left - right).items())[:2]}; only SQL: {list((right - left).items())[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import time

    import __spark_entry__ as entry
    from biblake.session import local_session

    root = f"/root/testdata/{sys.argv[1]}"
    spark, con = local_session(8, "8g"), connect(root)
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    for name, f in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and name.startswith("p"):
            continue
        begun = time.time()
        try:
            said = differences(spark, con, f, sql[name], root) if name in sql else f"{f(spark, root).count()} rows, no SQL"
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:500]}"
        print(f"{name} {time.time() - begun:.1f}s {said[:1300] or 'equal'}", flush=True)
