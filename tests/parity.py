"""Compare registered queries with their SQL: ``python tests/parity.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, Decimal)):
        return format(Decimal(value).normalize(), "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(Decimal(repr(value)).normalize(), "f")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return (len(got) > 0, f"rows only: {len(got)}")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(got), set(want)
    only_a, only_b = sorted(a - b), sorted(b - a)
    return False, (f"{len(got)} vs {len(want)} rows; {len(only_a)}/{len(only_b)} differ\n"
                   f"   columns {sorted(names)}\n   spark {only_a[:3]}\n   duck  {only_b[:3]}")


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s  {note}",
              flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
