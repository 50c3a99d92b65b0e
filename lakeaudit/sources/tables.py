"""Table scans.

The reference reads a whole SQLite table into a Python list and returns its
length. Here a scan is a lazy ``DataFrame``; its row count is collected by an
``Observation`` during whatever action consumes it, so counting costs no second
pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The driver's table names.
DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (Parquet, pushdown and pruning apply)."""
    return spark.read.parquet(table_path(sf_dir, name))




def scan(df: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The frame as stored (all columns, stored order, no filter) plus an
    Observation whose ``get["rows"]`` holds the row count once an action has
    consumed the returned frame. The count is exact under task retries when no
    shuffle follows the scan in that action (a write or a collect of the scan);
    a map stage that is re-run after a lost executor may report its rows twice."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
