"""Run registered queries and compare each with its SQL statement in DuckDB.

    python tools/check_oracle.py [-d folder] [name part ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    names = spark_df.columns
    mine = rows_of(names, spark_df.collect())
    cursor = con.execute(sql)
    other_names = [d[0] for d in cursor.description]
    theirs = rows_of(other_names, cursor.fetchall())
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} != {sorted(other_names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if not mine:
        return "both empty"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ ({sorted(names)}), e.g.\n    spark  {str(bad[0][0])[:600]}\n    duckdb {str(bad[0][1])[:600]}"
    return None


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("-d", "--dir", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    from mensura.plans import catalog  # noqa: F401
    from mensura.plans.registry import ORACLE, QUERIES
    from mensura.session import build_session

    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(opts.dir)
    failed = 0
    for name, run in QUERIES.items():
        if opts.names and not any(part in name for part in opts.names):
            continue
        start = time.time()
        try:
            df = run(spark, opts.dir)
            if name in ORACLE:
                problem = compare(df, con, ORACLE[name])
                mark = "ok" if problem is None else "DIFF"
            else:
                n = df.count()
                problem, mark = None, f"rows={n}"
        except Exception as error:  # noqa: BLE001
            text = str(error) or traceback.format_exc()
            problem, mark = text.split("JVM stacktrace")[0][:1200], "ERROR"
        failed += problem is not None
        print(f"{mark:8} {name}  {time.time() - start:.2f}s" + (f"\n    {problem}" if problem else ""), flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
