"""Parquet sink (S6), create-table-from-Parquet (S4) and schema drift.

The reference's Parquet path lets pandas infer types and copies them with
``CREATE TABLE … AS SELECT * FROM parquet.`path```. Spark runs the same
statement; here the observed schema is also compared with a contract and the
difference returned as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeaudit.contracts import Contract
from lakeaudit.sources.swap import Version, quoted


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """No index column (Spark has none). With partition columns, rows are
    first clustered by them (``REBALANCE`` hint) so each task writes few files
    per partition value, and AQE splits a partition value that holds a large
    share of the rows across several tasks instead of one."""
    writer_df = df
    if partition_by:
        writer_df = df.hint("rebalance", *partition_by)
    w = writer_df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_contract_parquet(df: DataFrame, path: str, contract: Contract, mode: str = "overwrite") -> None:
    """S6 with the contract's column order and partition columns."""
    write_parquet(df.select(*contract.column_names), path, contract.partition_by, mode)


def create_table_from_parquet(spark: SparkSession, table: str, path: str, replace: bool = False) -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS t AS SELECT * FROM parquet.`path```
    (schema inferred from the files). ``replace`` writes the new table beside the
    old one and swaps it in, so a missing or unreadable source leaves the old one."""
    source = "parquet.`" + path.replace("`", "``") + "`"
    if not replace:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(table)} USING PARQUET AS SELECT * FROM {source}")
        return spark.table(table)
    version = Version(spark, table)
    try:
        spark.sql(f"CREATE TABLE {quoted(version.name)} USING PARQUET LOCATION '{version.folder}' AS SELECT * FROM {source}")
    except Exception:
        version.discard()
        raise
    version.swap_in()
    return spark.table(table)


def schema_drift(spark: SparkSession, observed: T.StructType, contract: Contract) -> DataFrame:
    """Columns missing from, extra to, or typed differently from the contract:
    ``(column_name, change, expected_type, observed_type)``. Metadata only."""
    expected = {c.name: c.spark_type() for c in contract.columns}
    seen = {f.name: f.dataType for f in observed.fields}
    rows = []
    for name, dtype in expected.items():
        if name not in seen:
            rows.append((name, "missing", dtype.simpleString(), None))
        elif seen[name] != dtype:
            rows.append((name, "type_changed", dtype.simpleString(), seen[name].simpleString()))
    for name, dtype in seen.items():
        if name not in expected:
            rows.append((name, "extra", None, dtype.simpleString()))
    schema = "column_name string, change string, expected_type string, observed_type string"
    return spark.createDataFrame(rows, schema)
