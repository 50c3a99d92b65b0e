"""End-to-end migrations: the reference's three scripts re-aimed as Spark jobs.

* :func:`export_csv` — every table to a CSV folder (one folder of part files
  per table), with the row count observed during the write (S1 + S5).
* :func:`migrate_csv` — a folder of CSV exports into catalog tables under
  explicit contracts: create schema (fatal on failure), create each table from
  its contract, typed read, gate, staged reload, count verification, and a
  per-table report; one bad table does not stop the others (S2, S3, S7–S9,
  S11, S12).
* :func:`migrate_parquet` — a folder of Parquet exports into tables by
  drop-and-replace CTAS with inferred schemas, a drift report against the
  contracts, and count verification (S4, S10, S11).

Everything runs as Spark jobs over the files; the driver holds only the
per-table report rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.contracts import AUDIT_TABLES, CSV_TIMESTAMP_FORMAT, Contract
from lakeaudit.plans import loads
from lakeaudit.sources import csv as csv_source
from lakeaudit.sources import parquet

EXPORT_SCHEMA = "table_name string, path string, rows bigint, subsecond_rows bigint, status string, error string"
PARQUET_SCHEMA = (
    "table_name string, status string, source_rows bigint, target_rows bigint, "
    "matches boolean, drift_columns bigint, error string"
)


def _subsecond(df: DataFrame):
    """Rows holding a timestamp with a fractional second (any column)."""
    ts_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    if not ts_cols:
        return F.lit(False)
    cond = None
    for c in ts_cols:
        frac = (F.unix_micros(F.col(c).cast("timestamp")) % 1_000_000) != 0
        cond = frac if cond is None else (cond | frac)
    return F.coalesce(cond, F.lit(False))


def export_csv(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    out_dir: str,
    null_value: str = "",
    max_workers: int = 4,
    timestamp_format: str = CSV_TIMESTAMP_FORMAT,
) -> DataFrame:
    """Write each table under ``out_dir/<name>.csv/``; report rows per table.
    A table that fails is reported and skipped; independent tables are
    written up to ``max_workers`` at a time.

    The reference's timestamp format has whole seconds. Rows whose timestamps
    carry fractions are counted in the same pass; if the format would drop
    them, the table's status is ``lossy`` (pass a format with ``.SSSSSS`` to
    both this and :func:`migrate_csv` to keep them)."""
    keeps_fraction = "S" in timestamp_format

    def export(item):
        name, df = item
        path = f"{out_dir.rstrip('/')}/{name}.csv"
        try:
            obs = Observation(f"export:{name}")
            observed = df.observe(
                obs,
                F.count(F.lit(1)).alias("rows"),
                F.count(F.when(_subsecond(df), 1)).alias("subsecond"),
            )
            csv_source.write_csv(observed, path, null_value=null_value, timestamp_format=timestamp_format)
            m = obs.get
            lossy = m["subsecond"] > 0 and not keeps_fraction
            return (name, path, int(m["rows"]), int(m["subsecond"]), "lossy" if lossy else "ok", None)
        except Exception as exc:
            return (name, path, None, None, "failed", f"{type(exc).__name__}: {exc}")

    return spark.createDataFrame(loads.run_per_table(export, tables.items(), max_workers), EXPORT_SCHEMA)


def migrate_csv(
    spark: SparkSession,
    csv_dir: str,
    schema: str,
    contracts: Sequence[Contract] = AUDIT_TABLES,
    schema_location: str | None = None,
    multi_line: bool = True,
    null_value: str = "",
    timestamp_format: str = CSV_TIMESTAMP_FORMAT,
) -> DataFrame:
    """Load ``csv_dir/<table>.csv`` for every contract into ``schema.<table>``.
    Returns the multi-table load report (see ``loads.load_tables``)."""
    loads.create_schema(spark, schema, schema_location)
    base = csv_dir.rstrip("/")
    specs = []
    for contract in contracts:
        def reader(s, c=contract):
            loads.create_table(s, f"{schema}.{c.name}", c)
            return csv_source.read_typed_csv(
                s, f"{base}/{c.name}.csv", c, multi_line=multi_line, null_value=null_value,
                timestamp_format=timestamp_format,
            )

        specs.append(loads.TableLoad(contract.name, reader, contract, contract.partition_by))
    return loads.load_tables(spark, specs, schema=schema)


def migrate_parquet(
    spark: SparkSession,
    parquet_dir: str,
    schema: str,
    names: Sequence[str],
    contracts: dict[str, Contract] | None = None,
    schema_location: str | None = None,
) -> DataFrame:
    """Replace ``schema.<name>`` with ``CREATE TABLE … AS SELECT * FROM
    parquet.`dir/<name>.parquet``` for each name; report counts and the number
    of columns drifting from the contract (when one is given)."""
    loads.create_schema(spark, schema, schema_location)
    base = parquet_dir.rstrip("/")
    report = []
    for name in names:
        path = f"{base}/{name}.parquet"
        try:
            table = parquet.create_table_from_parquet(spark, f"{schema}.{name}", path, replace=True)
            drift = None
            if contracts and name in contracts:
                drift = parquet.schema_drift(spark, table.schema, contracts[name]).count()
            source_rows = spark.read.parquet(path).count()
            target_rows = table.count()
            report.append((name, "ok", source_rows, target_rows, source_rows == target_rows, drift, None))
        except Exception as exc:
            report.append((name, "failed", None, None, None, None, f"{type(exc).__name__}: {exc}"))
    return spark.createDataFrame(report, PARQUET_SCHEMA)
