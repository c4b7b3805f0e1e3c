"""Compare registered queries with their SQL on whole tables.

    python tests/parity.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(body, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark, con, name: str, sf_dir: str, plans: list | None = None):
    """None if equal, else a description of the first difference; and both times."""
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    if plans is not None:
        plans.append(df._jdf.queryExecution().toString())
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(got[1]), t1 - t0, 0.0
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        extra = set(got[1]) - set(want[1])
        lack = set(want[1]) - set(got[1])
        problem = f"{len(got[1])} rows != {len(want[1])}\n  only spark: {list(extra)[:2]}\n  only sql: {list(lack)[:2]}"
    else:
        for a, b in zip(got[1], want[1]):
            if a != b or [type(x) for x in a] != [type(x) for x in b]:
                problem = f"\n  spark {a}\n  sql   {b}"
                break
    return problem, len(got[1]), t1 - t0, t2 - t1


def main() -> int:
    from __spark_entry__ import queries
    from passagemill.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(cores=8, memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name in args.names or queries():
        try:
            problem, rows, t_spark, t_sql = compare(spark, con, name, args.sf)
        except Exception as error:
            problem, rows, t_spark, t_sql = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0, 0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:24s} rows={rows:6d} "
              f"spark={t_spark:6.2f}s sql={t_sql:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
