"""Absent columns, gold refreshes, table details, and swaps in which the table is never missing."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from lakeaudit.contracts import SILVER_ORDERS
from lakeaudit.operators import gate
from lakeaudit.operators.medallion import daily_revenue
from lakeaudit.operators.profile import profile
from lakeaudit.plans import catalog, loads
from lakeaudit.plans.gold import refresh_daily_revenue


@pytest.fixture()
def schema(spark, scratch):
    name = f"weak_{uuid.uuid4().hex[:8]}"
    loads.create_schema(spark, name, f"{scratch}/{name}")
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def test_an_absent_not_null_column_rejects_every_row(spark):
    needed = SILVER_ORDERS.not_null[0]
    others = [c for c in SILVER_ORDERS.schema().fields if c.name != needed]
    df = spark.createDataFrame([tuple(None for _ in others)], ",".join(f"{c.name} {c.dataType.simpleString()}" for c in others))
    (row,) = gate.tag(df, SILVER_ORDERS).collect()
    assert f"absent:{needed}" in row.reasons and row.is_rejected
    assert set(row.reasons) == {f"absent:{needed}"} | {f"null:{c}" for c in SILVER_ORDERS.not_null if c != needed}


ORDERS = "o_orderkey long, o_orderdate timestamp, o_orderpriority string"
LINES = "l_orderkey long, l_extendedprice double, l_discount double"


def test_gold_refresh_replaces_and_drops_months(spark, schema):
    day = dt.datetime(2024, 1, 10)
    orders = [(i, day + dt.timedelta(days=i), "hot" if i % 3 else "b") for i in range(120)]
    lines = spark.createDataFrame([(i % 130, 10.0 + i, 0.1) for i in range(400)], LINES)
    frame = lambda rows: spark.createDataFrame(rows, ORDERS)
    table = f"{schema}.daily_revenue"
    held = lambda: sorted(map(tuple, spark.table(table).drop("revenue_month").collect()))
    whole = lambda rows: sorted(map(tuple, daily_revenue(frame(rows), lines).collect()))
    with pytest.raises(ValueError, match="first write"):
        refresh_daily_revenue(spark, frame(orders), lines, table, dt.date(2024, 3, 1))
    refresh_daily_revenue(spark, frame(orders), lines, table)
    assert held() == whole(orders)
    # Since March: other orders in March, none in April; January and February are left as they were.
    later = [o for o in orders if o[1].month == 3 and o[0] % 2] + [(500, dt.datetime(2024, 1, 11), "late news")]
    for _ in range(2):
        refresh_daily_revenue(spark, frame(later), lines, table, dt.date(2024, 3, 9))
        assert held() == whole([o for o in orders if o[1].month < 3] + later[:-1])


def test_swap_keeps_the_table_readable(spark, schema, monkeypatch):
    """Between the catalog calls of a reload the table is there, with the old or the new rows."""
    table = f"{schema}.people"
    loads.reload_table(spark, spark.range(5).withColumn("name", F.lit("old")), table)
    seen, sql = [], type(spark).sql

    def watched(self, statement, *args, **kw):
        out = sql(self, statement, *args, **kw)
        if not statement.startswith(("DESCRIBE", "CREATE")):
            assert spark.catalog.tableExists(table), statement
            seen.append({r.name for r in spark.table(table).select("name").distinct().collect()})
        return out

    monkeypatch.setattr(type(spark), "sql", watched)
    for name in ("new", "newer"):
        assert loads.reload_table(spark, spark.range(7).withColumn("name", F.lit(name)), table) == 7
        assert spark.table(table).count() == 7 and {r.name for r in spark.table(table).collect()} == {name}
    assert seen and all(s in ({"old"}, {"new"}, {"newer"}) for s in seen)
    monkeypatch.undo()
    left = [r.tableName for r in spark.sql(f"SHOW TABLES IN {schema}").collect()]
    assert left == ["people"]


def test_describe_table_tells_owner_time_and_properties(spark, schema):
    table = f"{schema}.t"
    spark.sql(f"CREATE TABLE {table} (id BIGINT) USING PARQUET COMMENT 'about' TBLPROPERTIES ('team' = 'audit')")
    spark.range(3).write.insertInto(table)
    got = catalog.describe_table(spark, table)
    assert got["properties"]["team"] == "audit" and got["created_at"] and "owner" in got
    assert got["row_count"] == 3 and got["num_files"] >= 1 and got["size_bytes"] > 0


def test_distinct_counts_of_texts_by_hashes(spark):
    rows = [(None, None), ("", b""), ("a", b"a"), ("a", b"a"), ("a" * 100_000, b"x"), ("a" * 99_999 + "b", b"y")]
    got = {r.column_name: r.distinct_count for r in profile(spark.createDataFrame(rows, "t string, b binary")).collect()}
    assert got == {"t": 4, "b": 4}
