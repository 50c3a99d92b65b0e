"""The gold table ``daily_revenue``: its first write, and refreshes of its last months.

The table is partitioned by month, so a day's few rows do not become a file of their own. A
refresh computes the revenue of the months from ``since`` on only (the order date prunes the
scan), replaces those months and drops those that have no rows any more; earlier months are not
touched. Running a refresh again changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.operators.medallion import daily_revenue
from lakeaudit.plans.loads import overwrite_partitions, reload_table
from lakeaudit.session import staging_path
from lakeaudit.sources.swap import quoted, remove_folder

MONTH = "revenue_month"


def refresh_daily_revenue(
    spark: SparkSession, orders: DataFrame, lines: DataFrame, table: str, since: dt.date | None = None, order_ts: str = "o_orderdate"
) -> int:
    """Write the months from that of ``since`` on (all without it); returns the rows written.

    The columns are those of ``operators.medallion.daily_revenue`` and ``revenue_month`` (``yyyy-MM``).
    """
    first = since.replace(day=1) if since else None
    part = orders.where(F.col(order_ts) >= F.lit(first)) if first else orders
    gold = daily_revenue(part, lines, order_ts=order_ts).withColumn(MONTH, F.date_format("revenue_date", "yyyy-MM"))
    if first is None:
        return reload_table(spark, gold, table, [MONTH])
    if not spark.catalog.tableExists(table):
        raise ValueError(f"table {table} does not exist; its first write takes all months")
    path = staging_path(spark, "gold")
    gold.write.parquet(path)  # computed once, for the write and for the names of its months
    fresh = spark.read.schema(gold.schema).parquet(path)
    rows = overwrite_partitions(spark, fresh, table)
    months = {r[0] for r in fresh.select(MONTH).distinct().collect()}
    old = {r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {quoted(table)}").collect()}
    for month in sorted(m for m in old - months if m >= f"{first:%Y-%m}"):
        spark.sql(f"ALTER TABLE {quoted(table)} DROP PARTITION ({MONTH} = '{month}')")
    remove_folder(spark, path)
    return rows
