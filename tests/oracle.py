"""Compare registered queries with their SQL in DuckDB.

python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cores}]").appName("tabsonde")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in data]
    return sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir) -> str:
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only spark {[x for x in a if x not in set(b)][:2]} only sql {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} differ: {bad[:2]}" if bad else f"ok {len(a)} rows"


def main() -> int:
    import __spark_entry__ as e
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    failed = 0
    for name in args or q:
        t = time.time()
        try:
            if name in o:
                msg = compare(spark, con, q[name], o[name], sf_dir)
            else:
                msg = f"ok {q[name](spark, sf_dir).count()} rows (no SQL)"
        except Exception as ex:  # noqa: BLE001
            msg = f"ERROR {str(ex)[:700]}"
        failed += not msg.startswith("ok")
        print(f"{name}: {time.time() - t:.1f}s {msg[:1500]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
