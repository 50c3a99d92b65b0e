"""Catalog inventory as DataFrames (M1–M4).

The reference returns lists of dicts from a remote catalog service. Here each
listing is a small DataFrame (it can be filtered, joined and stored) built from
Spark's catalog API on the driver. Table details add statistics that Spark only
knows after a scan: row count, file count and bytes (from the ``_metadata``
file columns), and the column profile (``operators.profile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lakeaudit.operators.profile import profile


def list_catalogs(spark: SparkSession) -> DataFrame:
    """M1: ``(name, type, comment, owner)``; Spark exposes no type or owner."""
    rows = [(c.name, None, c.description, None) for c in spark.catalog.listCatalogs()]
    return spark.createDataFrame(rows, "name string, type string, comment string, owner string")


def list_schemas(spark: SparkSession, catalog: str) -> DataFrame:
    """M2: ``(name, catalog, owner, comment)``; an unknown catalog gives no rows
    (Spark raises for it; only that error is caught)."""
    schema = "name string, catalog string, owner string, comment string"
    try:
        shown = spark.sql("SHOW SCHEMAS IN IDENTIFIER(:c)", args={"c": catalog}).collect()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    rows = [(r[0], catalog, None, None) for r in shown]
    return spark.createDataFrame(rows, schema)


def list_tables(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    """M3: ``(name, type, format, catalog, schema)``; unknown → no rows."""
    out_schema = "name string, type string, format string, catalog string, schema string"
    try:
        tables = spark.catalog.listTables(f"{catalog}.{schema}" if catalog else schema)
    except AnalysisException:
        return spark.createDataFrame([], out_schema)
    rows = []
    for t in tables:
        fmt = None
        if t.tableType not in ("TEMPORARY", "VIEW"):
            try:
                detail = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)",
                                   args={"t": f"{t.namespace[-1]}.{t.name}" if t.namespace else t.name})
                prov = detail.filter(F.col("col_name") == "Provider").select("data_type").first()
                fmt = prov[0].upper() if prov else None
            except AnalysisException:
                fmt = None
        rows.append((t.name, t.tableType, fmt, catalog, schema))
    return spark.createDataFrame(rows, out_schema)


def table_stats(df: DataFrame) -> DataFrame:
    """Row count, file count, bytes and last modification of a file-based
    frame in one scan: the ``_metadata`` file columns are constant per file, so
    only row counts are read from the data."""
    meta = df.select(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_size").alias("s"),
        F.col("_metadata.file_modification_time").alias("m"),
    )
    per_file = meta.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"), F.max("m").alias("m"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).cast("bigint").alias("num_files"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.max("m").alias("updated_at"),
    )


def describe_table(
    spark: SparkSession, table: str, with_profile: bool = False, exact_distinct: bool = False
) -> dict:
    """M4: columns (name, type, nullable, comment), partition columns, format,
    location, owner, creation time, properties, row count, files, bytes and optionally the column profile.
    An unknown table raises (the reference's stub invented one).

    The counts come from one pass over file metadata and row counts. The
    profile reads every column and is off by default; when on, distinct counts
    are HyperLogLog++ unless ``exact_distinct`` (which shuffles every value)."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"Table not found: {table}")
    cols = spark.catalog.listColumns(table)
    columns = [
        {"name": c.name, "type": c.dataType, "nullable": c.nullable, "comment": c.description or ""}
        for c in cols
    ]
    detail = {
        r["col_name"]: r["data_type"]
        for r in spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)", args={"t": table}).collect()
    }
    df = spark.table(table)
    stats = table_stats(df).first()
    out = {
        "full_name": table,
        "table_type": detail.get("Type"),
        "data_source_format": (detail.get("Provider") or "").upper() or None,
        "comment": detail.get("Comment"),
        "owner": detail.get("Owner"),
        "created_at": detail.get("Created Time"),
        "properties": {
            r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES IDENTIFIER(:t)", args={"t": table}).collect()
        },
        "location": detail.get("Location"),
        "columns": columns,
        "partition_columns": [c.name for c in cols if c.isPartition],
        "row_count": stats["row_count"],
        "num_files": stats["num_files"],
        "size_bytes": stats["size_bytes"],
        "updated_at": stats["updated_at"],
    }
    if with_profile:  # one row per column
        out["profile"] = [r.asDict() for r in profile(df, exact=exact_distinct).collect()]
    return out
