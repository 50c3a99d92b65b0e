"""End-to-end migrations over audit-table CSV exports and Parquet folders."""

from __future__ import annotations

import csv
import os
import uuid

from lakeaudit.contracts import AUDIT_TABLES, CUSTOMERS, contract_from_schema
from lakeaudit.plans import migrate
from tests.conftest import SF_SMALL

ROWS = {
    "customers": [
        ["c1", "US", "tier1", "low", "2024-01-01", "2024-01-01 00:00:00"],
        ["c2", "MX", "tier2", "high", "2024-02-01", ""],
        ["c3", "", "tier2", "high", "2024-02-01", ""],  # NOT NULL country missing → quarantined
    ],
    "transactions": [
        ["t1", "c1", "US-MX", "US", "MX", "100.00", "USD", "1700.00", "MXN", "3.99", "3.99",
         "17.000000", "17.000000", "bank", "2024-03-02 00:00:00", "2024-03-01 12:00:00", "delivered",
         "2024-03-01 00:00:00"],
        ["t2", "c2", "US-MX", "US", "MX", "abc", "USD", "1700.00", "MXN", "3.99", "3.99",
         "17.000000", "17.000000", "bank", "2024-03-02 00:00:00", "", "pending", "2024-03-01 00:00:00"],
    ],
    "disclosures": [
        ["d1", "t1", "2024-03-01 00:00:00", "3.99", "17.000000", "1700.00", "1-2 days",
         "2024-03-01 00:01:00", "2024-03-01 00:30:00", ""],
    ],
    # violations: no file at all → that table fails at the read, the others load
    "audit_events": [
        ["e1", "t1", "created", "system", "2024-03-01 00:00:00", "1", '{"a": 1, "b": "x,y"}', ""],
        ["e2", "t1", "note", "agent", "2024-03-01 00:00:05", "2", "line one\nline two", ""],
    ],
}


def _write_exports(folder):
    """Write CSVs the way the reference's export does (csv module, header)."""
    os.makedirs(folder, exist_ok=True)
    for c in AUDIT_TABLES:
        if c.name not in ROWS:
            continue
        with open(os.path.join(folder, f"{c.name}.csv"), "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(c.column_names)
            w.writerows(ROWS[c.name])


def test_migrate_csv_folder(spark, scratch):
    folder = os.path.join(scratch, "exports")
    _write_exports(folder)
    schema = f"mig_{uuid.uuid4().hex[:8]}"
    report = {r["table_name"]: r for r in migrate.migrate_csv(
        spark, folder, schema, schema_location=os.path.join(scratch, schema)).collect()}
    assert report["customers"]["status"] == "ok"
    assert (report["customers"]["rows_read"], report["customers"]["rows_loaded"],
            report["customers"]["rows_rejected"]) == (3, 2, 1)
    assert report["transactions"]["rows_rejected"] == 1  # 'abc' in a decimal
    assert report["disclosures"]["rows_loaded"] == 1
    assert report["audit_events"]["rows_loaded"] == 2
    assert report["violations"]["status"] == "failed"
    assert spark.table(f"{schema}.audit_events").filter("event_id = 'e2'").first()["payload"] == "line one\nline two"
    # rerun: same rows, not doubled
    migrate.migrate_csv(spark, folder, schema, schema_location=os.path.join(scratch, schema))
    assert spark.table(f"{schema}.customers").count() == 2


def test_export_then_migrate_round_trip(spark, scratch):
    src = spark.createDataFrame(
        [("c1", "US", "tier1", "low", "2024-01-01", None), ("c2", "MX", "t,2", 'r"q', "2024-01-02", None)],
        "customer_id string, registration_country string, kyc_tier string, risk_level string, "
        "registration_date string, created_at timestamp",
    ).selectExpr("customer_id", "registration_country", "kyc_tier", "risk_level",
                 "to_date(registration_date) AS registration_date", "created_at")
    out = os.path.join(scratch, "out")
    exp = migrate.export_csv(spark, {"customers": src}, out).first()
    assert (exp["status"], exp["rows"]) == ("ok", 2)
    schema = f"rt_{uuid.uuid4().hex[:8]}"
    rep = migrate.migrate_csv(spark, out, schema, contracts=[CUSTOMERS],
                              schema_location=os.path.join(scratch, schema)).first()
    assert rep["status"] == "ok" and rep["rows_loaded"] == 2
    assert sorted(spark.table(f"{schema}.customers").collect()) == sorted(src.collect())


def test_migrate_parquet(spark, scratch):
    schema = f"pq_{uuid.uuid4().hex[:8]}"
    region = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    want = contract_from_schema("region", region.drop("r_name").schema)
    rep = {r["table_name"]: r for r in migrate.migrate_parquet(
        spark, SF_SMALL, schema, ["region", "nation", "missing"], {"region": want},
        schema_location=os.path.join(scratch, schema)).collect()}
    assert rep["region"]["matches"] and rep["region"]["target_rows"] == 5
    assert rep["region"]["drift_columns"] == 1  # r_name is extra to the contract
    assert rep["nation"]["matches"] and rep["nation"]["drift_columns"] is None
    assert rep["missing"]["status"] == "failed"


def test_command_line(spark, scratch, capsys):
    import json

    from lakeaudit.__main__ import main

    out = os.path.join(scratch, "csv")
    assert main(["export-csv", "--parquet-dir", SF_SMALL, "--tables", "region,nation", "--out-dir", out], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {r["table_name"]: r["rows"] for r in lines} == {"region": 5, "nation": 25}
    folder = os.path.join(scratch, "exports")
    _write_exports(folder)
    schema = f"cli_{uuid.uuid4().hex[:8]}"
    code = main(["migrate-csv", "--csv-dir", folder, "--schema", schema, "--tables", "customers,audit_events",
                 "--schema-location", os.path.join(scratch, schema)], spark)
    report = {r["table_name"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert code == 0 and report["customers"]["rows_loaded"] == 2 and report["audit_events"]["rows_loaded"] == 2


def test_export_flags_subsecond_loss(spark, scratch):
    import datetime as dt

    df = spark.createDataFrame(
        [(1, dt.datetime(2025, 1, 1, 0, 0, 0)), (2, dt.datetime(2025, 1, 1, 0, 0, 0, 250000))],
        "id int, ts timestamp_ntz",
    )
    lossy = migrate.export_csv(spark, {"t": df}, os.path.join(scratch, "a")).first()
    assert (lossy["status"], lossy["subsecond_rows"]) == ("lossy", 1)
    fine = migrate.export_csv(spark, {"t": df}, os.path.join(scratch, "b"),
                              timestamp_format="yyyy-MM-dd HH:mm:ss.SSSSSS").first()
    assert (fine["status"], fine["subsecond_rows"]) == ("ok", 1)


def test_command_line_inventory_and_sql(spark, scratch, capsys):
    import json

    from lakeaudit.__main__ import main

    assert main(["catalogs"], spark) == 0
    assert "spark_catalog" in capsys.readouterr().out
    assert main(["sql", "--statement", "SELECT id FROM range(5)", "--max-rows", "3"], spark) == 0
    res = json.loads(capsys.readouterr().out)
    assert (res["row_count"], res["truncated"], res["rows"]) == (3, True, [[0], [1], [2]])
    assert main(["ls", "--path", SF_SMALL], spark) == 0
    names = {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()}
    assert "orders.parquet" in names
    schema = f"cli2_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{os.path.join(scratch, schema)}'")
    spark.read.parquet(f"{SF_SMALL}/region.parquet").write.saveAsTable(f"{schema}.region")
    assert main(["describe", "--table", f"{schema}.region"], spark) == 0
    detail = json.loads(capsys.readouterr().out)
    assert detail["row_count"] == 5 and [c["name"] for c in detail["columns"]] == ["r_regionkey", "r_name"]


def test_command_line_remaining_subcommands(spark, scratch, capsys):
    import json

    from lakeaudit.__main__ import main

    schema = f"cli3_{uuid.uuid4().hex[:8]}"
    code = main(["migrate-parquet", "--parquet-dir", SF_SMALL, "--schema", schema, "--tables", "region,nation",
                 "--schema-location", os.path.join(scratch, schema)], spark)
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert code == 0 and {r["table_name"]: r["matches"] for r in rows} == {"region": True, "nation": True}
    assert main(["schemas", "--catalog", "spark_catalog"], spark) == 0
    assert schema in {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()}
    assert main(["tables", "--schema", schema], spark) == 0
    assert {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()} == {"region", "nation"}
    assert main(["stat", "--path", f"{SF_SMALL}/orders.parquet"], spark) == 0
    info = json.loads(capsys.readouterr().out)
    assert info["is_dir"] is False and info["file_size"] > 0

    # audit over a schema holding the five audit tables (loaded from the CSV exports)
    folder = os.path.join(scratch, "exports")
    _write_exports(folder)
    audit_schema = f"cli4_{uuid.uuid4().hex[:8]}"
    main(["migrate-csv", "--csv-dir", folder, "--schema", audit_schema,
          "--schema-location", os.path.join(scratch, audit_schema)], spark)
    capsys.readouterr()
    out = os.path.join(scratch, "audit")
    assert main(["audit", "--schema", audit_schema, "--out-dir", out, "--as-of", "2024-04-01 00:00:00"], spark) == 0
    outputs = {json.loads(x)["output"] for x in capsys.readouterr().out.splitlines()}
    assert {"violations", "quality_report", "trail_summary", "risk_exposure"} <= outputs
