"""Runs queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import datetime
import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr([plain(r[i]) for i in order]) for r in rows))


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"{name}: columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return f"{name}: {len(mine[1])} and {len(theirs[1])} rows; only here {sorted(a)[:2]}; only there {sorted(b)[:2]}"
    return None if mine[1] else f"{name}: no rows"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rpartition("/tests")[0])
    import time

    import __spark_entry__ as entry
    from orrery.session import build_session

    spark = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__execution__pyspark__udf__faulthandler__enabled="true")
    spark.sparkContext.setLogLevel("ERROR")
    found, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in found if n in sql]:
        if name not in sql:
            continue
        began = time.time()
        try:
            said = compare(spark, name, found[name], sql[name], f"/root/testdata/{sys.argv[1]}")
        except Exception as e:
            said = f"{name}: {type(e).__name__} {str(e)[:700]}"
        print(f"{time.time() - began:.1f}s", said or f"{name} ok", flush=True)
