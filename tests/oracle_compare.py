"""Differential check: a Spark binding against its DuckDB oracle SQL.

Both results are turned into sorted lists of rows whose values are rendered
strictly (decimal scale kept, timestamps as ISO text, floats by repr), with
columns in name order — the same shape of comparison the driver makes.

Run as a script to check every binding:
``python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from lakeaudit.sources.tables import DRIVER_TABLES  # noqa: E402


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return "D" + str(v)
    if isinstance(v, dt.datetime):
        return "T" + v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return "d" + v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if hasattr(v, "item"):
        return _canon(v.item())
    return f"{type(v).__name__}:{v}"


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in DRIVER_TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_canon(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, sorted(rows)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_canon(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(rows)


# Spark type name → DuckDB type name, for the schema comparison.
_TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT",
}


def type_mismatches(df, con, sql) -> list:
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        (c, t, duck_types.get(c))
        for c, t in spark_types.items()
        if _TYPE_NAMES.get(t, t.upper()) != duck_types.get(c)
    ]


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> dict:
    con = con or duck_connection(sf_dir)
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols, s_rows = spark_rows(df)
    t1 = time.time()
    d_cols, d_rows = duck_rows(con, sql)
    types = type_mismatches(df, con, sql)
    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": s_cols == d_cols,
        "values_match": s_rows == d_rows,
        "types_match": not types,
        "spark_sec": round(t1 - t0, 2),
    }
    if types:
        out["type_mismatches"] = types
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
    elif not out["values_match"]:
        ss, dd = set(s_rows), set(d_rows)
        out["only_spark"] = sorted(ss - dd)[:3]
        out["only_oracle"] = sorted(dd - ss)[:3]
    return out


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from lakeaudit.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = queries(), oracle_sql()
    con = duck_connection(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print({"name": name, "spark_rows": n, "oracle": None, "spark_sec": round(time.time() - t0, 2)})
            continue
        try:
            r = compare(spark, sf_dir, name, fn, sqls[name], con)
        except Exception as exc:  # report and go on
            r = {"name": name, "error": f"{type(exc).__name__}: {str(exc)[:500]}"}
        ok = (r.get("columns_match") and r.get("values_match") and r.get("types_match")
              and r.get("spark_rows") == r.get("oracle_rows"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} mismatches")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
