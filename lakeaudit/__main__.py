"""Command line (run with ``spark-submit`` or ``python -m lakeaudit``).

Loads:
    migrate-csv --csv-dir DIR --schema audit [--schema-location PATH]
    migrate-parquet --parquet-dir DIR --schema audit --tables a,b,c
    export-csv --parquet-dir DIR --tables a,b --out-dir DIR
Inventory and SQL:
    catalogs | schemas --catalog C | tables --catalog C --schema S
    describe --table schema.table
    sql --statement "SELECT ..." [--max-rows 100] [--catalog C] [--schema S]
    ls --path DIR | stat --path PATH
Runs:
    run --ledger DIR --job-id N --statement "SELECT ... :p" [--params JSON] [--out PATH | --table T]
    jobs --ledger DIR [--limit 25] | run-status --ledger DIR --run-id N
Audit:
    audit --schema S --out-dir DIR [--as-of TS] [--detected-at TS]

The master and cluster settings come from ``spark-submit`` / the environment;
the command adds only the package's SQL settings. Results are printed as JSON
lines (at most the bounded SQL rows, or one row per table/file/finding set).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from lakeaudit.contracts import AUDIT_TABLES
from lakeaudit.plans import bounded_sql, catalog, ledger, migrate
from lakeaudit.plans.audit_run import AuditParams, run_audit
from lakeaudit.session import build_session
from lakeaudit.sources import files


def _print(report: DataFrame) -> None:
    for row in report.toLocalIterator():  # one small row per table
        print(json.dumps(row.asDict(), default=str))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakeaudit")
    sub = parser.add_subparsers(dest="command", required=True)

    m = sub.add_parser("migrate-csv", help="load a folder of CSV exports into contract tables")
    m.add_argument("--csv-dir", required=True)
    m.add_argument("--schema", required=True)
    m.add_argument("--schema-location")
    m.add_argument("--tables", help="comma-separated subset of the audit tables")
    m.add_argument("--single-line", action="store_true", help="records hold no embedded newlines")

    p = sub.add_parser("migrate-parquet", help="replace tables from a folder of Parquet exports")
    p.add_argument("--parquet-dir", required=True)
    p.add_argument("--schema", required=True)
    p.add_argument("--schema-location")
    p.add_argument("--tables", required=True)

    e = sub.add_parser("export-csv", help="write Parquet tables out as CSV folders")
    e.add_argument("--parquet-dir", required=True)
    e.add_argument("--tables", required=True)
    e.add_argument("--out-dir", required=True)

    sub.add_parser("catalogs", help="list catalogs")
    c = sub.add_parser("schemas", help="list schemas of a catalog")
    c.add_argument("--catalog", default="spark_catalog")
    t = sub.add_parser("tables", help="list tables of a schema")
    t.add_argument("--catalog", default="spark_catalog")
    t.add_argument("--schema", required=True)
    d = sub.add_parser("describe", help="columns, format, rows, files, bytes and profile of a table")
    d.add_argument("--table", required=True)
    q = sub.add_parser("sql", help="run one statement, bounded result")
    q.add_argument("--statement", required=True)
    q.add_argument("--max-rows", type=int, default=bounded_sql.DEFAULT_MAX_ROWS)
    q.add_argument("--catalog", default="")
    q.add_argument("--schema", default="")
    ls = sub.add_parser("ls", help="direct children of a folder")
    ls.add_argument("--path", default="/")
    st = sub.add_parser("stat", help="one file or folder")
    st.add_argument("--path", required=True)
    a = sub.add_parser("audit", help="all compliance checks over the five audit tables of a schema")
    a.add_argument("--schema", required=True)
    a.add_argument("--out-dir", required=True)
    a.add_argument("--as-of")
    a.add_argument("--detected-at", default="2025-01-01 00:00:00")

    r = sub.add_parser("run", help="run a parameterised step and record it in the ledger")
    r.add_argument("--ledger", required=True)
    r.add_argument("--job-id", type=int, required=True)
    r.add_argument("--statement", required=True)
    r.add_argument("--params")
    r.add_argument("--out")
    r.add_argument("--table")
    r.add_argument("--name", default="")
    j = sub.add_parser("jobs", help="jobs seen in the ledger")
    j.add_argument("--ledger", required=True)
    j.add_argument("--limit", type=int, default=25)
    rs = sub.add_parser("run-status", help="state of one run")
    rs.add_argument("--ledger", required=True)
    rs.add_argument("--run-id", type=int, required=True)

    args = parser.parse_args(argv)
    spark = spark or build_session(app_name=f"lakeaudit-{args.command}")

    if args.command == "run":
        result = ledger.run_job(spark, args.ledger, args.job_id, args.statement, args.params,
                                args.out, args.name, output_table=args.table)
        print(json.dumps(result, default=str))
        return 0 if result.get("state") == "SUCCESS" else 1
    if args.command == "jobs":
        _print(ledger.list_jobs(spark, args.ledger, args.limit))
        return 0
    if args.command == "run-status":
        _print(ledger.get_job_run(spark, args.ledger, args.run_id))
        return 0

    if args.command in ("catalogs", "schemas", "tables", "ls", "stat"):
        frames = {
            "catalogs": lambda: catalog.list_catalogs(spark),
            "schemas": lambda: catalog.list_schemas(spark, args.catalog),
            "tables": lambda: catalog.list_tables(spark, args.catalog, args.schema),
            "ls": lambda: files.list_files(spark, args.path),
            "stat": lambda: files.file_info(spark, args.path),
        }
        _print(frames[args.command]())
        return 0
    if args.command == "describe":
        print(json.dumps(catalog.describe_table(spark, args.table), default=str))
        return 0
    if args.command == "sql":
        res = bounded_sql.execute_sql(spark, args.statement, args.catalog, args.schema, args.max_rows)
        print(res.to_json())
        return 0
    if args.command == "audit":
        tables = {n: spark.table(f"{args.schema}.{n}") for n in ("customers", "transactions", "disclosures", "audit_events")}
        params = AuditParams(detected_at=args.detected_at, as_of=args.as_of)
        report = run_audit(spark, tables["customers"], tables["transactions"], tables["disclosures"],
                           tables["audit_events"], params, args.out_dir)
        _print(report)
        return 0

    if args.command == "migrate-csv":
        contracts = AUDIT_TABLES
        if args.tables:
            wanted = set(args.tables.split(","))
            contracts = tuple(c for c in AUDIT_TABLES if c.name in wanted)
        report = migrate.migrate_csv(
            spark, args.csv_dir, args.schema, contracts, args.schema_location, multi_line=not args.single_line
        )
    elif args.command == "migrate-parquet":
        contracts = {c.name: c for c in AUDIT_TABLES}
        report = migrate.migrate_parquet(
            spark, args.parquet_dir, args.schema, args.tables.split(","), contracts, args.schema_location
        )
    else:
        base = args.parquet_dir.rstrip("/")
        frames = {t: spark.read.parquet(f"{base}/{t}.parquet") for t in args.tables.split(",")}
        report = migrate.export_csv(spark, frames, args.out_dir)
    _print(report)
    failed = report.filter("status <> 'ok'").count()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
