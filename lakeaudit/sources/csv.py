"""Typed CSV load (S2) and CSV sink.

The reference's load options are header on, no inference, timestamp format
``yyyy-MM-dd HH:mm:ss`` and empty text as NULL. Two corrections are ours:

* ``escape='"'``: files from Python's ``csv`` module double embedded quotes;
  with Spark's default escape (backslash) a JSON payload such as
  ``{"a": 1, "b": "x,y"}`` is cut at its comma and shifts the row's columns.
* ``multiLine``: embedded newlines inside quotes. It makes each file
  unsplittable, so land many files rather than one large one. Off by default
  for input known to have no embedded newlines.

The sink writes a directory of part files (one per task), header in each, and
keeps leading/trailing blanks (Spark trims them on write by default).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeaudit.contracts import CSV_NULL_VALUE, CSV_TIMESTAMP_FORMAT, Contract
from lakeaudit.operators.gate import CORRUPT


def read_schema(contract: Contract | T.StructType, with_corrupt: bool = True) -> T.StructType:
    schema = contract.schema() if isinstance(contract, Contract) else contract
    if with_corrupt and CORRUPT not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    return schema


def read_options(
    multi_line: bool = True, timestamp_format: str = CSV_TIMESTAMP_FORMAT, null_value: str = CSV_NULL_VALUE
) -> dict[str, object]:
    """The reader options, for batch and stream alike. A file whose header does not name the
    schema's columns in its order fails the read (``enforceSchema`` off) instead of being
    read by position."""
    return {
        "header": True,
        "enforceSchema": False,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "timestampFormat": timestamp_format,
        "timestampNTZFormat": timestamp_format,
        "nullValue": null_value,
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "encoding": "UTF-8",
    }


def header_schema(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, object]) -> T.StructType:
    """``schema`` in the order of the header at ``path`` (names without regard to case).
    A header that lacks a column, repeats one or names an unknown one raises. Files without
    any line keep the schema's order."""
    try:
        names = spark.read.options(**options).option("inferSchema", False).csv(path).columns
    except AnalysisException as exc:
        if exc.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # a folder without files
            raise
        names = []
    if not names:
        return schema
    known = {f.name.lower(): f for f in schema.fields}
    found = [n.lower() for n in names]
    if sorted(found) != sorted(known):
        missing = [f.name for f in schema.fields if f.name.lower() not in found]
        unknown = [n for n in names if n.lower() not in known]
        raise ValueError(f"header of {path} does not fit the schema: missing {missing}, unknown or repeated {unknown}, header {names}")
    return T.StructType([known[n] for n in found])


def read_typed_csv(
    spark: SparkSession,
    path: str,
    contract: Contract | T.StructType,
    multi_line: bool = True,
    with_corrupt: bool = True,
    timestamp_format: str = CSV_TIMESTAMP_FORMAT,
    null_value: str = CSV_NULL_VALUE,
) -> DataFrame:
    """CSV read against an explicit schema, PERMISSIVE, malformed lines kept
    in ``_corrupt_record`` for the gate. Columns are found by their header name.
    Values that do not fit the schema (a bad timestamp, text in a number, a
    decimal overflow) make the line corrupt."""
    options = read_options(multi_line, timestamp_format, null_value)
    ordered = header_schema(spark, path, read_schema(contract, False), options)
    df = spark.read.schema(read_schema(ordered, with_corrupt)).options(**options).csv(path)
    return df.select(*read_schema(contract, with_corrupt).fieldNames())


def write_csv(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    null_value: str = CSV_NULL_VALUE,
    timestamp_format: str = CSV_TIMESTAMP_FORMAT,
) -> None:
    """Header row, UTF-8, minimal quoting with doubled quotes, NULL as
    ``null_value`` (empty by default, as the reference; pass ``\\N`` to keep
    NULL and empty text apart), blanks kept."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null_value)
        .option("emptyValue", '""')
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
        .csv(path)
    )
