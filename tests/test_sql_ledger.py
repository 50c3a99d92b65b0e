"""Bounded SQL (Q1–Q3) and the run ledger."""

from __future__ import annotations

import json
import os

import pytest

from lakeaudit.plans import bounded_sql, ledger
from tests.conftest import SF_SMALL


@pytest.fixture()
def view(spark):
    spark.range(10).createOrReplaceTempView("ten")
    return "ten"


@pytest.mark.parametrize("n,rows,truncated", [(9, 9, True), (10, 10, False), (11, 10, False), (0, 0, True)])
def test_truncation(spark, view, n, rows, truncated):
    r = bounded_sql.execute_sql(spark, "SELECT id FROM ten ORDER BY id", max_rows=n, new_session=False)
    assert (r.row_count, r.truncated) == (rows, truncated)
    assert r.columns == ["id"]
    assert [x[0] for x in r.rows] == list(range(rows))


def test_cap_at_1000(spark):
    r = bounded_sql.execute_sql(spark, "SELECT id FROM range(5000)", max_rows=1000)
    assert (r.row_count, r.truncated) == (1000, True)
    with pytest.raises(ValueError, match="export_sql"):
        bounded_sql.execute_sql(spark, "SELECT id FROM range(5000)", max_rows=1001)


def test_export_writes_the_whole_result(spark):
    path = bounded_sql.export_sql(spark, "SELECT id FROM range(:n)", args={"n": 5000})
    assert spark.read.parquet(path).count() == 5000


def test_select_1_and_result_shape(spark):
    r = bounded_sql.execute_sql(spark, "SELECT 1")
    assert r.rows == [[1]] and r.row_count == 1 and r.truncated is False
    assert set(json.loads(r.to_json())) >= {"columns", "rows", "row_count", "truncated"}


def test_negative_rejected(spark):
    with pytest.raises(ValueError):
        bounded_sql.execute_sql(spark, "SELECT 1", max_rows=-1)


def test_ddl_and_two_statements(spark, scratch):
    loc = os.path.join(scratch, "db")
    r = bounded_sql.execute_sql(spark, f"CREATE SCHEMA IF NOT EXISTS q1_ddl LOCATION '{loc}'")
    assert r.row_count == 0
    with pytest.raises(Exception):
        bounded_sql.execute_sql(spark, "SELECT 1; SELECT 2")


def test_scoped_session_does_not_leak(spark, scratch):
    loc = os.path.join(scratch, "db2")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS q2_scope LOCATION '{loc}'")
    before = spark.catalog.currentDatabase()
    r = bounded_sql.execute_sql(spark, "SELECT current_database() AS db", schema="q2_scope")
    assert r.rows == [["q2_scope"]]
    assert spark.catalog.currentDatabase() == before


def test_views_in_scoped_session(spark):
    r = bounded_sql.execute_sql(
        spark, "SELECT count(*) AS n FROM orders", views={"orders": f"{SF_SMALL}/orders.parquet"}
    )
    assert r.rows[0][0] == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()


def test_parameters_bind_not_splice(spark):
    r = bounded_sql.execute_sql(spark, "SELECT :x AS v", args={"x": "a'; DROP TABLE t; --"})
    assert r.rows == [["a'; DROP TABLE t; --"]]


def test_json_rows(spark):
    df = spark.sql("SELECT 1 AS a, CAST(2.50 AS DECIMAL(5,2)) AS d, DATE'2025-01-02' AS dt")
    row = bounded_sql.result_json_rows(df).first()[0]
    assert json.loads(row) == {"a": 1, "d": 2.5, "dt": "2025-01-02"}


def test_ledger_runs(spark, scratch):
    lp = os.path.join(scratch, "ledger")
    stmt = f"SELECT o_orderkey FROM parquet.`{SF_SMALL}/orders.parquet` WHERE o_orderstatus = :status"
    run = ledger.run_job(spark, lp, 102, stmt, '{"status": "F"}', os.path.join(scratch, "out"), "orders F")
    assert run["state"] == "SUCCESS" and run["params"] == {"status": "F"}
    expected = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_orderstatus = 'F'").count()
    assert run["rows_written"] == expected
    assert ledger.run_job(spark, lp, 102, stmt, "{not json")["error"].startswith("params must be valid JSON")
    assert "error" in ledger.run_job(spark, lp, 102, stmt, "[1, 2]")
    failed = ledger.run_job(spark, lp, 103, "SELECT * FROM no_such_table", None, os.path.join(scratch, "o2"))
    assert failed["state"] == "FAILED"
    got = ledger.get_job_run(spark, lp, run["run_id"]).collect()
    assert len(got) == 1 and got[0]["result_state"] == "SUCCESS" and got[0]["end_time"] is not None
    assert ledger.get_job_run(spark, lp, 424242).count() == 0
    jobs = ledger.list_jobs(spark, lp, limit=1).collect()
    assert [j["job_id"] for j in jobs] == [102]
    assert [r["more_jobs"] for r in jobs] == [True]
    assert [r["more_jobs"] for r in ledger.list_jobs(spark, lp).collect()] == [False, False]


def test_default_namespace_from_settings(spark, scratch):
    loc = os.path.join(scratch, "db3")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS q2_default LOCATION '{loc}'")
    spark.conf.set(bounded_sql.DEFAULT_SCHEMA_KEY, "q2_default")
    try:
        r = bounded_sql.execute_sql(spark, "SELECT current_database() AS db", schema="")
        assert r.rows == [["q2_default"]]
        r = bounded_sql.execute_sql(spark, "SELECT current_database() AS db", schema="default")
        assert r.rows == [["default"]]
    finally:
        spark.conf.unset(bounded_sql.DEFAULT_SCHEMA_KEY)
    r = bounded_sql.execute_sql(spark, "SELECT current_database() AS db")
    assert r.rows == [[spark.catalog.currentDatabase()]]


def test_ledger_run_to_table(spark, scratch):
    loc = os.path.join(scratch, "db4")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS p1_out LOCATION '{loc}'")
    stmt = f"SELECT o_orderkey FROM parquet.`{SF_SMALL}/orders.parquet` WHERE o_totalprice >= :floor"
    run = ledger.run_job(spark, os.path.join(scratch, "ledger"), 7, stmt, '{"floor": 100000}',
                         output_table="p1_out.big_orders")
    assert run["state"] == "SUCCESS"
    assert spark.table("p1_out.big_orders").count() == run["rows_written"] > 0


def test_command_line_runs(spark, scratch, capsys):
    from lakeaudit.__main__ import main

    lp = os.path.join(scratch, "ledger")
    stmt = f"SELECT o_orderkey FROM parquet.`{SF_SMALL}/orders.parquet` WHERE o_orderstatus = :s"
    assert main(["run", "--ledger", lp, "--job-id", "5", "--statement", stmt, "--params", '{"s": "O"}',
                 "--out", os.path.join(scratch, "o")], spark) == 0
    run = json.loads(capsys.readouterr().out)
    assert run["state"] == "SUCCESS" and run["params"] == {"s": "O"}
    assert main(["run", "--ledger", lp, "--job-id", "5", "--statement", stmt, "--params", "{oops"], spark) == 1
    assert "error" in json.loads(capsys.readouterr().out)
    assert main(["jobs", "--ledger", lp], spark) == 0
    assert [json.loads(x)["job_id"] for x in capsys.readouterr().out.splitlines()] == [5]
    assert main(["run-status", "--ledger", lp, "--run-id", str(run["run_id"])], spark) == 0
    assert json.loads(capsys.readouterr().out)["result_state"] == "SUCCESS"
