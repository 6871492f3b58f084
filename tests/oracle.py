"""Runs every query with SQL in Spark and DuckDB and compares rows: python -m tests.oracle [sf_dir] [name ...]"""

import math
import os
import sys
import time


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, queries, sql, names=None, say=print):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    bad = []
    for name in names or sql:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            a = rows_of(df.columns, df.collect())
            u = time.time()
            got = db.execute(sql[name])
            b = rows_of([c[0] for c in got.description], got.fetchall())
            if a == b:
                say(f"ok {name} {len(a[1])} rows, {u - t:.1f} s, DuckDB {time.time() - u:.1f} s")
                continue
            bad.append(name)
            say(f"DIFFERS {name}: {a[0]} {len(a[1])} rows, SQL {b[0]} {len(b[1])} rows")
            x, y = set(a[1]), set(b[1])
            say("  spark only", sorted(x - y)[:3], "\n  sql only", sorted(y - x)[:3])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            say(f"ERROR {name}: {str(e)[:600]}")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from gapline.plans import catalog

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    bad = compare(session, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", catalog.queries(), catalog.oracle_sql(), sys.argv[2:] or None)
    print("bad:", bad)
