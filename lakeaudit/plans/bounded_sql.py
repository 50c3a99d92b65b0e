"""Bounded SQL execution (Q1–Q3).

``execute_sql`` runs one statement and returns at most ``max_rows`` rows
(default 100, at most 1,000; a request above that raises) with a ``truncated`` flag.
It fetches ``n + 1`` rows — Spark plans ``CollectLimit`` (or
``TakeOrderedAndProject`` under an ORDER BY), so executors stop early and the
driver never holds more than 1,001 rows — and reports truncation when the
extra row exists. The reference's stub cut the rows before comparing, so its
flag was always false; its live client counted rows before the cut. ``export_sql``
writes the whole result to the shared folder instead, past no driver.

Each call runs in a fresh session (``newSession``) so a call's default catalog
and schema do not leak into the next. Temp views are per session, so views the
statement needs are re-registered in it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeaudit.functions.json import row_json
from lakeaudit.session import staging_path

# The reference's default and maximum result size.
DEFAULT_MAX_ROWS = 100
MAX_ROWS_CAP = 1000


@dataclass
class SqlResult:
    columns: list[str]
    rows: list[list]
    row_count: int
    truncated: bool
    statement: str = ""
    schema: T.StructType | None = None

    def to_json(self) -> str:
        """JSON text; values JSON cannot hold (dates, decimals) as text."""
        return json.dumps(
            {"columns": self.columns, "rows": self.rows, "row_count": self.row_count,
             "truncated": self.truncated},
            default=str,
        )


# Session settings holding the default namespace for bounded SQL calls.
DEFAULT_CATALOG_KEY = "spark.lakeaudit.sql.defaultCatalog"
DEFAULT_SCHEMA_KEY = "spark.lakeaudit.sql.defaultSchema"


def default_namespace(spark: SparkSession, catalog: str | None, schema: str | None) -> tuple[str | None, str | None]:
    """Q2: an empty catalog/schema falls back to the session's configured
    default, then to None (the session's current namespace)."""
    catalog = catalog or spark.conf.get(DEFAULT_CATALOG_KEY, None) or None
    schema = schema or spark.conf.get(DEFAULT_SCHEMA_KEY, None) or None
    return catalog, schema


def effective_limit(max_rows: int) -> int:
    if max_rows is None:
        max_rows = DEFAULT_MAX_ROWS
    if max_rows < 0:
        raise ValueError("max_rows must be >= 0")
    if max_rows > MAX_ROWS_CAP:
        raise ValueError(f"max_rows may be {MAX_ROWS_CAP} at most; export_sql writes the whole result")
    return int(max_rows)


def scoped_session(
    spark: SparkSession,
    catalog: str | None = None,
    schema: str | None = None,
    views: dict[str, str] | None = None,
    fmt: str = "parquet",
) -> SparkSession:
    """Q2: a new session with its own current catalog/schema. Temp views do not
    cross sessions, so ``views`` (name → source path) are registered in it."""
    try:
        s = spark.newSession()
    except PySparkNotImplementedError:  # a client without child sessions: use the caller's
        s = spark
    if catalog:
        s.catalog.setCurrentCatalog(catalog)
    if schema:
        s.catalog.setCurrentDatabase(schema)
    for name, path in (views or {}).items():
        s.read.format(fmt).load(path).createOrReplaceTempView(name)
    return s


def export_sql(
    spark: SparkSession,
    statement: str,
    catalog: str | None = None,
    schema: str | None = None,
    args: dict | None = None,
    views: dict[str, str] | None = None,
    path: str | None = None,
) -> str:
    """Q1 without a bound: the statement's whole result as Parquet; returns the folder
    (``path``, or a fresh one in the shared folder)."""
    catalog, schema = default_namespace(spark, catalog, schema)
    path = path or staging_path(spark, "sql-result")
    scoped_session(spark, catalog, schema, views).sql(statement, args=args).write.parquet(path)
    return path


def execute_sql(
    spark: SparkSession,
    statement: str,
    catalog: str | None = None,
    schema: str | None = None,
    max_rows: int = DEFAULT_MAX_ROWS,
    args: dict | None = None,
    new_session: bool = True,
    views: dict[str, str] | None = None,
) -> SqlResult:
    """Q1: run one statement, return ≤ ``max_rows`` rows and ``truncated``.

    ``row_count`` is the number of rows *returned*. DDL and other commands run
    eagerly and return no rows. Several statements in one text raise (Spark
    parses one statement). Parameters bind as named markers, never spliced."""
    n = effective_limit(max_rows)
    catalog, schema = default_namespace(spark, catalog, schema)
    session = scoped_session(spark, catalog, schema, views) if new_session else spark
    if not new_session:
        if catalog:
            session.catalog.setCurrentCatalog(catalog)
        if schema:
            session.catalog.setCurrentDatabase(schema)
    df = session.sql(statement, args=args)
    fetched = df.limit(n + 1).collect()
    truncated = len(fetched) > n
    rows = [list(r) for r in fetched[:n]]
    return SqlResult(df.columns, rows, len(rows), truncated, statement, df.schema)


def result_json_rows(df: DataFrame, keep=()) -> DataFrame:
    """Q3 on the executors: one JSON object per row (all columns), next to any
    ``keep`` columns."""
    return df.select(*keep, row_json(*df.columns).alias("json"))
