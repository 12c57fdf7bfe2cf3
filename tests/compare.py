"""Comparing a query with its SQL, as the driver does."""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

DATA = os.environ.get("ORDERLOOM_TEST_DATA", "/root/testdata/sf0.001")


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differ(query, sql, spark, sf_dir):
    """(number of Spark rows, of SQL rows, an example of a difference or '')."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = views(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), len(want), f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return len(got), len(want), f"{sorted(names)}: {a} and {b}"
    return len(got), len(want), ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, s = e.queries(), e.oracle_sql()
    sf = sys.argv[1]
    names = [n for n in q if any(n.startswith(x) for x in sys.argv[2:])] if sys.argv[2:] else list(q)
    for n in names:
        t = time.time()
        try:
            if n in s:
                print(n, *differ(q[n], s[n], spark, sf), f"{time.time() - t:.1f} s", flush=True)
            else:
                print(n, q[n](spark, sf).count(), "rows", f"{time.time() - t:.1f} s", flush=True)
        except Exception as x:
            print(n, "FAILED", str(x)[:700], flush=True)
