"""Operators bound to the driver's tables, each with its DuckDB oracle SQL.

The audit operators are written against the reference's compliance contracts
(transactions, disclosures, …); the driver's data is a TPC-H-like star schema.
Each binding maps one operator onto those tables (``orders`` as transactions,
``lineitem`` as their lines/disclosures/trail, ``events`` as the event stream)
and states the same computation in plain SQL, so the driver can compare the
two at sf0.01. Every binding reads whole tables; none samples or caps rows
except where a limit is the feature (bounded SQL, top-n).

Conventions that keep both sides identical: money is summed in DECIMAL with an
explicit result width; every computed column is aliased and cast on both sides
(``row_number`` is INT in Spark and BIGINT in DuckDB, ``sum(int)`` differs in
width, …); timestamps stay TIMESTAMP_NTZ, which is DuckDB's TIMESTAMP.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.contracts import Contract, contract_from_schema
from lakeaudit.functions.money import money
from lakeaudit.operators import deadlines, gate, medallion, quality, reconcile, summaries, trails
from lakeaudit.operators.profile import profile
from lakeaudit.operators.segmented import latest_per_key, range_blocks
from lakeaudit.plans import bounded_sql, catalog, ledger, loads
from lakeaudit.session import staging_path
from lakeaudit.sources import csv as csv_source
from lakeaudit.sources import files, parquet
from lakeaudit.sources.swap import remove_folder
from lakeaudit.sources.tables import DRIVER_TABLES, read_table, scan, table_path
from lakeaudit.streaming import bronze

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def binding(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# Parameters of the bindings (ours; the reference fixes none of them).
DETECTED_AT = "2025-01-01 00:00:00"
TOTAL_TOLERANCE = 0.01
PROMISE_DAYS = 120
RECEIPT_LIMIT_DAYS = 90
CANCEL_DAYS = 30
ORDER_STATUS_DOMAIN = ("F", "O")
ORDER_PRIORITY_DOMAIN = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_KINDS = ("click", "error", "purchase", "signup", "view")
FUNNEL_STEPS = ("view", "click", "purchase")


# =============================================================== G4 (flagship)
G4_SQL = """
WITH per_order AS (
  SELECT l_orderkey AS order_key,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS gross,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS net
  FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o_orderdate AS DATE) AS revenue_date,
       o_orderpriority AS channel,
       CAST(SUM(gross) AS DECIMAL(22,2)) AS gross_revenue,
       CAST(SUM(net) AS DECIMAL(26,4)) AS net_revenue,
       CAST(COUNT(*) AS BIGINT) AS order_count
FROM orders JOIN per_order ON o_orderkey = order_key
GROUP BY CAST(o_orderdate AS DATE), o_orderpriority
"""


@binding("g4_daily_revenue", G4_SQL)
def g4_daily_revenue(spark, sf_dir):
    return medallion.daily_revenue(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"))


# ======================================================================== G3
_LINE_TIE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

G3_SQL = f"""
SELECT {", ".join(_LINE_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY {", ".join(c + " DESC" for c in _LINE_TIE)}) AS rn
  FROM lineitem) WHERE rn = 1
"""


@binding("g3_silver_lineitem", G3_SQL)
def g3_silver_lineitem(spark, sf_dir):
    """Latest line per (order, line number) by ship date; other columns break ties."""
    return medallion.silver_dedupe(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


G3_ORDERS_SQL = """
SELECT o_orderkey, o_custkey, lower(trim(o_orderstatus)) AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE lower(trim(o_orderstatus)) IN ('f', 'o')
"""


@binding("g3_silver_orders", G3_ORDERS_SQL)
def g3_silver_orders(spark, sf_dir):
    """Silver orders: latest row per order key, status normalised, rows
    outside the status domain quarantined (the good side is returned)."""
    good, _bad = medallion.silver_orders(
        _t(spark, sf_dir, "orders"), key="o_orderkey", order=["o_orderdate"],
        status="o_orderstatus", domain=[s.lower() for s in ORDER_STATUS_DOMAIN],
    )
    return good


# ======================================================================== G5
G5_SQL = """
SELECT c_custkey, c_name, c_mktsegment,
       CAST(COALESCE(o.n, 0) AS BIGINT) AS order_count,
       CAST(COALESCE(o.amt, 0) AS DECIMAL(22,2)) AS lifetime_amount,
       o.first_order_at, o.last_order_at
FROM customer LEFT JOIN (
  SELECT o_custkey, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS amt,
         MIN(o_orderdate) AS first_order_at, MAX(o_orderdate) AS last_order_at
  FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey
"""


@binding("g5_lifetime_value", G5_SQL)
def g5_lifetime_value(spark, sf_dir):
    return medallion.lifetime_value(
        _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), user_cols=("c_name", "c_mktsegment")
    )


G5_RUNNING_SQL = """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(22,2)) AS running_amount
FROM orders
"""


@binding("g5_running_amount", G5_RUNNING_SQL)
def g5_running_amount(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return medallion.running_amount(o)


# ======================================================================== G6
G6_SQL = """
WITH t1 AS (SELECT user_id, MIN(ts) AS t1 FROM events
            WHERE event_type = 'view' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id),
t2 AS (SELECT e.user_id, MIN(e.ts) AS t2 FROM events e JOIN t1 ON e.user_id = t1.user_id
       WHERE e.event_type = 'click' AND e.ts >= t1.t1 GROUP BY e.user_id),
t3 AS (SELECT e.user_id, MIN(e.ts) AS t3 FROM events e JOIN t2 ON e.user_id = t2.user_id
       WHERE e.event_type = 'purchase' AND e.ts >= t2.t2 GROUP BY e.user_id)
SELECT 1 AS step_no, 'view' AS step_name, CAST(COUNT(*) AS BIGINT) AS users FROM t1
UNION ALL SELECT 2, 'click', CAST(COUNT(*) AS BIGINT) FROM t2
UNION ALL SELECT 3, 'purchase', CAST(COUNT(*) AS BIGINT) FROM t3
"""


@binding("g6_funnel", G6_SQL)
def g6_funnel(spark, sf_dir):
    return medallion.funnel(_t(spark, sf_dir, "events"), FUNNEL_STEPS)


# ======================================================================== G7
def _g7_sql() -> str:
    parts = []
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]:
        parts.append(
            f"SELECT 'orders' AS table_name, 'not_null' AS check_name, '{c}' AS column_name, "
            f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS failed_rows, "
            f"CAST(COUNT(*) AS BIGINT) AS total_rows FROM orders"
        )
    dom = ", ".join(f"'{v}'" for v in ORDER_STATUS_DOMAIN)
    parts.append(
        "SELECT 'orders', 'domain', 'o_orderstatus', "
        f"CAST(COUNT(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ({dom})) AS BIGINT), "
        "CAST(COUNT(*) AS BIGINT) FROM orders"
    )
    parts.append(
        "SELECT 'lineitem', 'unique_key', 'l_orderkey,l_linenumber', "
        "CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT), CAST(COALESCE(SUM(n), 0) AS BIGINT) "
        "FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"
    )
    parts.append(
        "SELECT 'lineitem', 'foreign_key', 'l_orderkey', "
        "CAST(COUNT(*) FILTER (WHERE l_orderkey IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS BIGINT), CAST(COUNT(*) AS BIGINT) FROM lineitem"
    )
    parts.append(
        "SELECT 'orders', 'foreign_key', 'o_custkey', "
        "CAST(COUNT(*) FILTER (WHERE o_custkey IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS BIGINT), CAST(COUNT(*) AS BIGINT) FROM orders"
    )
    parts.append(
        "SELECT 'orders', 'has_child', 'o_orderkey', "
        "CAST(COUNT(*) FILTER (WHERE o_orderkey IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS BIGINT), CAST(COUNT(*) AS BIGINT) FROM orders"
    )
    return "\nUNION ALL\n".join(parts)


@binding("g7_quality_report", _g7_sql())
def g7_quality_report(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    lines = _t(spark, sf_dir, "lineitem")
    customer = _t(spark, sf_dir, "customer")
    parts = [
        quality.column_checks(
            orders, "orders",
            not_null=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
            domains={"o_orderstatus": ORDER_STATUS_DOMAIN},
        ),
        quality.key_check(lines, "lineitem", ["l_orderkey", "l_linenumber"]),
        quality.foreign_key_check(lines, "lineitem", "l_orderkey", orders, "o_orderkey"),
        quality.foreign_key_check(orders, "orders", "o_custkey", customer, "c_custkey"),
        quality.foreign_key_check(orders, "orders", "o_orderkey", lines, "l_orderkey").withColumn(
            "check_name", F.lit("has_child")
        ),
    ]
    return quality.union_reports(parts)


_G7C_SQL = """
SELECT 'documents' AS table_name, 'not_null' AS check_name, 'text' AS column_name,
       CAST(COUNT(*) FILTER (WHERE text IS NULL) AS BIGINT) AS failed_rows, CAST(COUNT(*) AS BIGINT) AS total_rows
FROM documents
UNION ALL
SELECT 'documents', 'unique_key', 'doc_id', CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT),
       CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM documents GROUP BY doc_id)
UNION ALL
SELECT 'labels', 'not_null', 'doc_id', CAST(COUNT(*) FILTER (WHERE doc_id IS NULL) AS BIGINT),
       CAST(COUNT(*) AS BIGINT) FROM labels
UNION ALL
SELECT 'labels', 'domain', 'quality',
       CAST(COUNT(*) FILTER (WHERE quality IS NOT NULL AND quality NOT IN (0, 1)) AS BIGINT),
       CAST(COUNT(*) AS BIGINT) FROM labels
UNION ALL
SELECT 'labels', 'domain', 'toxic',
       CAST(COUNT(*) FILTER (WHERE toxic IS NOT NULL AND toxic NOT IN (0, 1)) AS BIGINT),
       CAST(COUNT(*) AS BIGINT) FROM labels
UNION ALL
SELECT 'labels', 'unique_key', 'doc_id', CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT),
       CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM labels GROUP BY doc_id)
UNION ALL
SELECT 'labels', 'foreign_key', 'doc_id',
       CAST(COUNT(*) FILTER (WHERE doc_id IS NOT NULL AND NOT EXISTS
            (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)) AS BIGINT),
       CAST(COUNT(*) AS BIGINT) FROM labels
UNION ALL
SELECT 'conversations', 'unique_key', 'conv_id,turn', CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT),
       CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM conversations GROUP BY conv_id, turn)
UNION ALL
SELECT 'embeddings', 'unique_key', 'vec_id', CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT),
       CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM embeddings GROUP BY vec_id)
UNION ALL
SELECT 'pages', 'not_null', 'url', CAST(COUNT(*) FILTER (WHERE url IS NULL) AS BIGINT),
       CAST(COUNT(*) AS BIGINT) FROM pages
UNION ALL
SELECT 'pages', 'unique_key', 'page_id', CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT),
       CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM pages GROUP BY page_id)
"""


@binding("g7_quality_content_tables", _G7C_SQL)
def g7_quality_content_tables(spark, sf_dir):
    """The same quality checks over the content tables: keys, the labels →
    documents foreign key, NOT NULL text and url, 0/1 label domains."""
    docs = _t(spark, sf_dir, "documents")
    labels = _t(spark, sf_dir, "labels")
    parts = [
        quality.column_checks(docs, "documents", not_null=["text"]),
        quality.key_check(docs, "documents", ["doc_id"]),
        quality.column_checks(labels, "labels", not_null=["doc_id"], domains={"quality": (0, 1), "toxic": (0, 1)}),
        quality.key_check(labels, "labels", ["doc_id"]),
        quality.foreign_key_check(labels, "labels", "doc_id", docs, "doc_id"),
        quality.key_check(_t(spark, sf_dir, "conversations"), "conversations", ["conv_id", "turn"]),
        quality.key_check(_t(spark, sf_dir, "embeddings"), "embeddings", ["vec_id"]),
        quality.column_checks(_t(spark, sf_dir, "pages"), "pages", not_null=["url"]),
        quality.key_check(_t(spark, sf_dir, "pages"), "pages", ["page_id"]),
    ]
    return quality.union_reports(parts)


# ======================================================================== G8
def _g8_sql() -> str:
    cols = []
    for k in EVENT_KINDS:
        cols.append(f"CAST(COUNT(*) FILTER (WHERE event_type = '{k}') AS BIGINT) AS n_{k}")
        cols.append(
            f"CAST(COALESCE(SUM(CAST(value AS DECIMAL(12,2))) FILTER (WHERE event_type = '{k}'), 0) "
            f"AS DECIMAL(22,2)) AS value_{k}"
        )
    return (
        "SELECT user_id, " + ", ".join(cols)
        + ", CAST(COUNT(*) AS BIGINT) AS n_events, MIN(ts) AS first_seen, MAX(ts) AS last_seen, "
        "CASE WHEN COUNT(*) > 1 THEN CAST(epoch_us(MAX(ts)) - epoch_us(MIN(ts)) AS DOUBLE) "
        "/ CAST(1000000 AS DOUBLE) / CAST(COUNT(*) - 1 AS DOUBLE) END "
        "AS mean_gap_seconds FROM events GROUP BY user_id"
    )


@binding("g8_user_features", _g8_sql())
def g8_user_features(spark, sf_dir):
    return medallion.user_features(_t(spark, sf_dir, "events"), EVENT_KINDS)


# ==================================================================== G2, G1
G2_HOURLY_SQL = """
SELECT date_trunc('hour', ts) AS window_start, event_type,
       CAST(COUNT(*) AS BIGINT) AS events,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS value
FROM events GROUP BY date_trunc('hour', ts), event_type
"""


@binding("g2_hourly_event_counts", G2_HOURLY_SQL)
def g2_hourly_event_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    # date_trunc returns a zoned TIMESTAMP; the input is wall-clock, so is the hour.
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return e.groupBy(hour.alias("window_start"), "event_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("events"),
        F.sum(money("value")).cast("decimal(22,2)").alias("value"),
    )


G1_SQL = "SELECT * FROM events"


@binding("g1_bronze_events", G1_SQL)
def g1_bronze_events(spark, sf_dir):
    """Stream the events file through the bronze ingest (watermarked dedupe on
    event_id, availableNow) into a Parquet sink, then read the sink."""
    schema = _t(spark, sf_dir, "events").schema
    out = staging_path(spark, "bronze-events")
    bronze.bronze_ingest(
        spark, sf_dir, schema, f"{out}/sink", f"{out}/checkpoint",
        key=["event_id"], ts="ts", watermark="1 hour", path_glob="events.parquet",
    )
    return spark.read.parquet(f"{out}/sink").select(*schema.fieldNames())


G2_STREAM_SQL = """
SELECT date_trunc('day', ts) AS window_start,
       date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type,
       CAST(COUNT(*) AS BIGINT) AS events,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS value
FROM events
GROUP BY date_trunc('day', ts), event_type
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR
"""


@binding("g2_stream_daily_windows", G2_STREAM_SQL)
def g2_stream_daily_windows(spark, sf_dir):
    """Daily tumbling windows per event type from a stream with a one-hour
    watermark, append mode: only windows the watermark has closed appear."""
    schema = _t(spark, sf_dir, "events").schema
    out = staging_path(spark, "event-windows")
    bronze.windowed_ingest(
        spark, sf_dir, schema, f"{out}/sink", f"{out}/checkpoint",
        ts="ts", window="1 day", by=["event_type"], value="value", watermark="1 hour",
        path_glob="events.parquet",
    )
    return spark.read.parquet(f"{out}/sink")


# ======================================================================== C1
def _c1_frame(spark, sf_dir, how: str = "inner") -> DataFrame:
    """orders ⋈ per-order line charge: stated total vs actual charge."""
    per_order = medallion.line_totals(_t(spark, sf_dir, "lineitem"))
    o = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), "o_custkey", "o_totalprice",
        F.col("o_orderpriority").alias("corridor"),
    )
    return o.join(per_order, "order_key", how)


def c1_rule() -> reconcile.Rule:
    return reconcile.Rule(
        "TOTAL_MISMATCH", money("o_totalprice"), F.col("charge").cast("decimal(30,6)"), TOTAL_TOLERANCE,
        "order total differs from the sum of its line charges",
    )

_C1_CTE = f"""
per_order AS (
  SELECT l_orderkey AS order_key,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))
                  * (1 + CAST(l_tax AS DECIMAL(12,2)))) AS DECIMAL(30,6)) AS charge
  FROM lineitem GROUP BY l_orderkey),
j AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, o_orderpriority AS corridor,
         CAST(o_totalprice AS DECIMAL(12,2)) AS stated, charge AS actual
  FROM orders JOIN per_order ON o_orderkey = order_key),
r AS (
  SELECT tx_id, corridor, stated, actual, actual - stated AS d,
         TRY_CAST((actual - stated) * 100 / stated AS DECIMAL(8,4)) AS pct
  FROM j),
viol AS (
  SELECT md5(tx_id || ':' || 'TOTAL_MISMATCH') AS violation_id, tx_id, 'TOTAL_MISMATCH' AS rule_id,
         CASE WHEN pct IS NULL THEN 'high' WHEN abs(pct) >= 10 THEN 'high'
              WHEN abs(pct) >= 1 THEN 'medium' ELSE 'low' END AS severity,
         CAST(stated AS VARCHAR) AS disclosed_value, CAST(actual AS VARCHAR) AS actual_value,
         TRY_CAST(d AS DECIMAL(12,6)) AS delta, pct AS delta_pct,
         'order total differs from the sum of its line charges' AS description,
         TIMESTAMP '{DETECTED_AT}' AS detected_at, corridor
  FROM r WHERE abs(d) > {TOTAL_TOLERANCE})
"""

_VIOLATION_COLS = ["violation_id", "tx_id", "rule_id", "severity", "disclosed_value", "actual_value",
                   "delta", "delta_pct", "description", "detected_at"]


def _c1_violations(spark, sf_dir) -> DataFrame:
    return reconcile.reconcile(_c1_frame(spark, sf_dir), "order_key", [c1_rule()], DETECTED_AT, keep=["corridor"])


@binding("c1_reconcile_orders", f"WITH {_C1_CTE} SELECT * FROM viol")
def c1_reconcile_orders(spark, sf_dir):
    return _c1_violations(spark, sf_dir).select(*_VIOLATION_COLS, "corridor")


# ======================================================================== C2
C2_SQL = f"""
SELECT o_orderkey AS tx_id, l_linenumber,
       o_orderdate + INTERVAL {PROMISE_DAYS} DAY AS promised_delivery_ts,
       l_shipdate AS actual_delivery_ts, 'late' AS status,
       CAST(date_diff('second', o_orderdate + INTERVAL {PROMISE_DAYS} DAY, l_shipdate) AS BIGINT) AS delay_seconds
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate > o_orderdate + INTERVAL {PROMISE_DAYS} DAY
"""


@binding("c2_late_lines", C2_SQL)
def c2_late_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_orderkey").alias("tx_id"), "l_linenumber",
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(PROMISE_DAYS))).alias("promised_delivery_ts"),
        F.col("l_shipdate").alias("actual_delivery_ts"),
    )
    return deadlines.late_or_undelivered(j, keep=["tx_id", "l_linenumber"])


# ======================================================================== C3
C3_SQL = """
SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
"""


@binding("c3_orders_without_lines", C3_SQL)
def c3_orders_without_lines(spark, sf_dir):
    return reconcile.missing_counterpart(
        _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"
    )


# ======================================================================== C4
C4_SQL = f"""
WITH f AS (SELECT l_orderkey, MIN(l_shipdate) AS receipt_sent_at FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey AS tx_id, o_orderdate AS disclosed_at, f.receipt_sent_at,
             o_orderdate + INTERVAL {CANCEL_DAYS} DAY AS cancellation_deadline
      FROM orders LEFT JOIN f ON o_orderkey = f.l_orderkey)
SELECT tx_id, disclosed_at, receipt_sent_at, cancellation_deadline, 'receipt_missing' AS check_name
FROM b WHERE receipt_sent_at IS NULL
UNION ALL
SELECT tx_id, disclosed_at, receipt_sent_at, cancellation_deadline, 'receipt_late'
FROM b WHERE receipt_sent_at > disclosed_at + INTERVAL {RECEIPT_LIMIT_DAYS} DAY
UNION ALL
SELECT tx_id, disclosed_at, receipt_sent_at, cancellation_deadline, 'deadline_invalid'
FROM b WHERE cancellation_deadline < disclosed_at
"""


@binding("c4_receipt_checks", C4_SQL)
def c4_receipt_checks(spark, sf_dir):
    """Order date as the disclosure, first ship date as the receipt (NULL for
    orders without lines), order date + 30 days as the cancellation deadline."""
    first = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("receipt_sent_at"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    b = o.join(first, o["o_orderkey"] == first["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_orderdate").alias("disclosed_at"),
        "receipt_sent_at",
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(CANCEL_DAYS))).alias("cancellation_deadline"),
    )
    return deadlines.receipt_checks(b, receipt_limit_seconds=RECEIPT_LIMIT_DAYS * 86400, keep=["tx_id"])


# ======================================================================== C5
def c5_rule() -> reconcile.Rule:
    return reconcile.Rule(
        "LIST_PRICE_DRIFT", money("p_retailprice") * money("l_quantity"), money("l_extendedprice"),
        TOTAL_TOLERANCE, "line price differs from list price times quantity",
    )

C5_SQL = f"""
WITH j AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS tx_id,
         CAST(p_retailprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(12,2)) AS stated,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS actual
  FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT tx_id, stated, actual, actual - stated AS d,
             TRY_CAST((actual - stated) * 100 / stated AS DECIMAL(8,4)) AS pct FROM j)
SELECT md5(tx_id || ':' || 'LIST_PRICE_DRIFT') AS violation_id, tx_id, 'LIST_PRICE_DRIFT' AS rule_id,
       CASE WHEN pct IS NULL THEN 'high' WHEN abs(pct) >= 10 THEN 'high'
            WHEN abs(pct) >= 1 THEN 'medium' ELSE 'low' END AS severity,
       CAST(stated AS VARCHAR) AS disclosed_value, CAST(actual AS VARCHAR) AS actual_value,
       TRY_CAST(d AS DECIMAL(12,6)) AS delta, pct AS delta_pct,
       'line price differs from list price times quantity' AS description,
       TIMESTAMP '{DETECTED_AT}' AS detected_at
FROM r WHERE abs(d) > {TOTAL_TOLERANCE}
"""


@binding("c5_list_price_drift", C5_SQL)
def c5_list_price_drift(spark, sf_dir):
    """The price stated in two places (part list price × quantity, and the
    line's extended price) compared with the same one-pass rule engine. The id is the
    line's: order, line number, part and supplier (line numbers repeat within an order)."""
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = _t(spark, sf_dir, "lineitem").select(key.alias("line"), "l_partkey", "l_quantity", "l_extendedprice")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    return reconcile.reconcile(j, "line", [c5_rule()], DETECTED_AT).select(*_VIOLATION_COLS)


# ======================================================================== C6
C6_LINES_SQL = """
WITH s AS (
  SELECT l_orderkey, l_linenumber, l_shipdate,
         lag(l_linenumber) OVER w AS prev_seq, lag(l_shipdate) OVER w AS prev_clock
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate)),
g AS (
  SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n_events,
         CAST(MIN(l_linenumber) AS BIGINT) AS first_seq, CAST(MAX(l_linenumber) AS BIGINT) AS last_seq,
         CAST(COUNT(*) FILTER (WHERE l_linenumber > prev_seq + 1) AS BIGINT) AS n_gaps,
         CAST(COUNT(*) FILTER (WHERE l_linenumber = prev_seq) AS BIGINT) AS n_duplicates,
         CAST(COUNT(*) FILTER (WHERE l_shipdate < prev_clock) AS BIGINT) AS n_backwards
  FROM s GROUP BY l_orderkey)
SELECT *, (first_seq = 1 AND n_gaps = 0 AND n_duplicates = 0 AND n_backwards = 0) AS is_clean FROM g
"""


@binding("c6_trail_lineitem", C6_LINES_SQL)
def c6_trail_lineitem(spark, sf_dir):
    """Each order's lines as an audit trail: line number = sequence, ship
    date = wall clock."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return trails.trail_summary(lines, "l_orderkey", "l_linenumber", "l_shipdate")


C6_EVENTS_SQL = """
WITH n AS (
  SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_num
  FROM events),
s AS (
  SELECT user_id, sequence_num, ts,
         lag(sequence_num) OVER w AS prev_seq, lag(ts) OVER w AS prev_clock
  FROM n WINDOW w AS (PARTITION BY user_id ORDER BY sequence_num, ts, event_id)),
g AS (
  SELECT user_id, CAST(COUNT(*) AS BIGINT) AS n_events,
         CAST(MIN(sequence_num) AS BIGINT) AS first_seq, CAST(MAX(sequence_num) AS BIGINT) AS last_seq,
         CAST(COUNT(*) FILTER (WHERE sequence_num > prev_seq + 1) AS BIGINT) AS n_gaps,
         CAST(COUNT(*) FILTER (WHERE sequence_num = prev_seq) AS BIGINT) AS n_duplicates,
         CAST(COUNT(*) FILTER (WHERE ts < prev_clock) AS BIGINT) AS n_backwards
  FROM s GROUP BY user_id)
SELECT *, (first_seq = 1 AND n_gaps = 0 AND n_duplicates = 0 AND n_backwards = 0) AS is_clean FROM g
"""


@binding("c6_trail_events", C6_EVENTS_SQL)
def c6_trail_events(spark, sf_dir):
    """Each user's events as a trail: the sequence number is the rank of the
    event id within the user (a very active user is split across tasks by the rows'
    ranges), the clock is ``ts``."""
    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    blocked, block = range_blocks(e, "user_id", ["event_id", "ts"])
    return trails.numbered_trail_summary(blocked, "user_id", ["event_id"], block, clock="ts")


C6_SUPPLIERS_SQL = """
WITH n AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate, row_number() OVER w AS sequence_num,
         lag(l_orderkey) OVER w AS prev_order, lag(l_linenumber) OVER w AS prev_line,
         lag(l_shipdate) OVER w AS prev_clock
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate)),
g AS (
  SELECT l_suppkey, CAST(COUNT(*) AS BIGINT) AS n_events,
         CAST(MIN(sequence_num) AS BIGINT) AS first_seq, CAST(MAX(sequence_num) AS BIGINT) AS last_seq,
         CAST(0 AS BIGINT) AS n_gaps,
         CAST(COUNT(*) FILTER (WHERE l_orderkey = prev_order AND l_linenumber = prev_line) AS BIGINT) AS n_duplicates,
         CAST(COUNT(*) FILTER (WHERE l_shipdate < prev_clock) AS BIGINT) AS n_backwards
  FROM n GROUP BY l_suppkey)
SELECT *, (first_seq = 1 AND n_duplicates = 0 AND n_backwards = 0) AS is_clean FROM g
"""


@binding("c6_trail_suppliers", C6_SUPPLIERS_SQL)
def c6_trail_suppliers(spark, sf_dir):
    """Each supplier's lines by order and line number, ship date as the clock: trails with
    repeated places and a clock that runs backwards."""
    lines = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    order = ["l_orderkey", "l_linenumber"]
    blocked, block = range_blocks(lines, "l_suppkey", [*order, "l_shipdate"])
    return trails.numbered_trail_summary(blocked, "l_suppkey", order, block, clock="l_shipdate")


# ======================================================================== C7
C7_SQL = """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS payload_valid
FROM events
"""


@binding("c7_payload_props", C7_SQL)
def c7_payload_props(spark, sf_dir):
    return summaries.payload_fields(_t(spark, sf_dir, "events"), {"k": "$.k:bigint"}, payload="props")


# ======================================================================== C8
def _c8_sql(group_clause: str) -> str:
    return f"""
WITH {_C1_CTE}
SELECT severity, rule_id, corridor,
       CAST(COUNT(*) AS BIGINT) AS violations,
       CAST(SUM(abs(delta)) AS DECIMAL(22,6)) AS abs_delta,
       CAST(GROUPING(severity) AS INTEGER) AS g_severity,
       CAST(GROUPING(rule_id) AS INTEGER) AS g_rule_id,
       CAST(GROUPING(corridor) AS INTEGER) AS g_corridor
FROM viol GROUP BY {group_clause}
"""


_C8_DIMS = ("severity", "rule_id", "corridor")
_C8_SETS = (("severity", "corridor"), ("rule_id",), ())


@binding("c8_violation_rollup", _c8_sql("ROLLUP (severity, rule_id, corridor)"))
def c8_violation_rollup(spark, sf_dir):
    return summaries.violation_summary(_c1_violations(spark, sf_dir), _C8_DIMS, "rollup")


@binding("c8_violation_cube", _c8_sql("CUBE (severity, rule_id, corridor)"))
def c8_violation_cube(spark, sf_dir):
    return summaries.violation_summary(_c1_violations(spark, sf_dir), _C8_DIMS, "cube")


@binding("c8_violation_sets", _c8_sql("GROUPING SETS ((severity, corridor), (rule_id), ())"))
def c8_violation_sets(spark, sf_dir):
    return summaries.violation_summary(_c1_violations(spark, sf_dir), _C8_DIMS, "sets", _C8_SETS)


# ======================================================================== C9
C9_SQL = f"""
WITH {_C1_CTE},
v AS (SELECT DISTINCT tx_id FROM viol WHERE severity = 'high'),
t AS (SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS amt FROM orders),
c AS (SELECT c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT t.amt, v.tx_id IS NOT NULL AS bad, c.n_name, c.c_mktsegment
      FROM t LEFT JOIN v ON t.tx_id = v.tx_id JOIN c ON t.o_custkey = c.c_custkey)
SELECT n_name, c_mktsegment,
       CAST(COUNT(*) AS BIGINT) AS n_tx,
       CAST(COUNT(*) FILTER (WHERE bad) AS BIGINT) AS n_violating,
       CAST(SUM(amt) AS DECIMAL(22,2)) AS total_amount,
       CAST(COALESCE(SUM(amt) FILTER (WHERE bad), 0) AS DECIMAL(22,2)) AS violating_amount,
       CAST(CAST(COALESCE(SUM(amt) FILTER (WHERE bad), 0) AS DECIMAL(22,2)) AS DOUBLE)
         / CAST(CAST(SUM(amt) AS DECIMAL(22,2)) AS DOUBLE) AS violating_share
FROM x GROUP BY n_name, c_mktsegment
"""


@binding("c9_risk_exposure", C9_SQL)
def c9_risk_exposure(spark, sf_dir):
    """Tier = (nation name, market segment); a transaction is violating when it
    has a high-severity total mismatch."""
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    customers = cust.join(nation, cust["c_nationkey"] == nation["n_nationkey"]).select(
        F.col("c_custkey").alias("customer_id"), "n_name", "c_mktsegment"
    )
    # The rule is judged on every order once and its outcome carried along with customer
    # and amount, so orders are read and joined once; orders without lines violate nothing.
    judged = reconcile.reconcile(
        _c1_frame(spark, sf_dir, "left"), "order_key", [c1_rule()], DETECTED_AT,
        only_violations=False, keep=["o_custkey", "o_totalprice", "charge"],
    ).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("_amt"),
        (F.col("charge").isNotNull() & F.col("violated") & (F.col("severity") == "high")).alias("_bad"),
    )
    return summaries.exposure_by(judged.join(customers, "customer_id"), ("n_name", "c_mktsegment"))


# ======================================================================== S1
@binding("s1_scan_customer", "SELECT * FROM customer")
def s1_scan_customer(spark, sf_dir):
    df, _obs = scan(_t(spark, sf_dir, "customer"), "customer")
    return df


# ======================================================================== S2
_CSV_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@binding("s2_csv_roundtrip_events", "SELECT * FROM events")
def s2_csv_roundtrip_events(spark, sf_dir):
    """Write events with the CSV sink, read them back typed (explicit schema,
    doubled-quote escaping for the JSON ``props``), drop the corrupt column."""
    events = _t(spark, sf_dir, "events")
    path = staging_path(spark, "csv-events")
    csv_source.write_csv(events, path, timestamp_format=_CSV_TS)
    back = csv_source.read_typed_csv(spark, path, events.schema, multi_line=False, timestamp_format=_CSV_TS)
    return back.select(*events.columns)


# ======================================================================== S3
def _orders_contract(schema) -> Contract:
    base = contract_from_schema("orders", schema)
    cols = tuple(type(c)(c.name, c.dtype, False, c.comment, c.data_type) for c in base.columns)
    return Contract(
        "orders", cols, key=("o_orderkey",),
        domains={"o_orderstatus": ORDER_STATUS_DOMAIN, "o_orderpriority": ORDER_PRIORITY_DOMAIN},
    )


def _s3_sql() -> str:
    parts = []
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]:
        parts.append(f"SELECT o_orderkey, 'null:{c}' AS reason FROM orders WHERE {c} IS NULL")
    for c, dom in (("o_orderstatus", ORDER_STATUS_DOMAIN), ("o_orderpriority", ORDER_PRIORITY_DOMAIN)):
        vals = ", ".join(f"'{v}'" for v in dom)
        parts.append(
            f"SELECT o_orderkey, 'domain:{c}' AS reason FROM orders WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})"
        )
    return "\nUNION ALL\n".join(parts)


@binding("s3_gate_orders", _s3_sql())
def s3_gate_orders(spark, sf_dir):
    """Contract gate over orders: one row per (rejected order, reason)."""
    orders = _t(spark, sf_dir, "orders")
    tagged = gate.tag(orders, _orders_contract(orders.schema))
    return gate.reason_rows(tagged, ["o_orderkey"])


# ======================================================================== S4
def _scratch_schema(spark, label: str) -> str:
    name = f"la_{label}_{uuid.uuid4().hex[:10]}"
    loads.create_schema(spark, name, staging_path(spark, name))
    return name


def _drop_scratch(spark, schema: str, *folders: str) -> None:
    """Drop a scratch schema with its tables' files, once nothing reads them any more."""
    location = spark.catalog.getDatabase(schema).locationUri
    spark.sql(f"DROP SCHEMA {schema} CASCADE")
    for folder in (location, *folders):
        remove_folder(spark, folder)


@binding("s4_ctas_region", "SELECT * FROM region")
def s4_ctas_region(spark, sf_dir):
    """``CREATE TABLE … AS SELECT * FROM parquet.`path``` into a scratch schema
    located in the shared staging folder; the table is read back."""
    schema = _scratch_schema(spark, "ctas")
    return parquet.create_table_from_parquet(spark, f"{schema}.region", table_path(sf_dir, "region"))


# =================================================================== S9, S10
@binding("s9_first_partitioned_load", "SELECT * FROM orders")
def s9_first_partitioned_load(spark, sf_dir):
    """A reload into a table that does not exist yet, partitioned by status."""
    orders, table = _t(spark, sf_dir, "orders"), f"{_scratch_schema(spark, 'first')}.orders"
    loads.reload_table(spark, orders, table, ["o_orderstatus"])
    return spark.table(table).select(*orders.columns)


@binding("s9_reload_partitioned", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def s9_reload_partitioned(spark, sf_dir):
    """All orders, then a second load without one status: the table holds the second load."""
    orders, table = _t(spark, sf_dir, "orders"), f"{_scratch_schema(spark, 'reload')}.orders"
    loads.reload_table(spark, orders, table, ["o_orderstatus"])
    loads.reload_table(spark, orders.where(F.col("o_orderstatus") != "P"), table, ["o_orderstatus"])
    return spark.table(table).select(*orders.columns)


@binding("s10_replace_table", "SELECT * FROM customer")
def s10_replace_table(spark, sf_dir):
    """Drop-and-replace by rows of another schema."""
    table = f"{_scratch_schema(spark, 'replace')}.parties"
    loads.replace_table(spark, _t(spark, sf_dir, "supplier"), table)
    loads.replace_table(spark, _t(spark, sf_dir, "customer"), table)
    return spark.table(table)


# ======================================================================== S6
@binding("s6_parquet_roundtrip_orders", "SELECT * FROM orders")
def s6_parquet_roundtrip_orders(spark, sf_dir):
    """Parquet sink partitioned by status, read back in the stored column order."""
    orders = _t(spark, sf_dir, "orders")
    path = staging_path(spark, "orders-by-status")
    parquet.write_parquet(orders, path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).select(*orders.columns)


# ======================================================================= S11
_S11_TABLES = DRIVER_TABLES  # all fourteen tables

S11_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS source_rows, "
    f"CAST(COUNT(*) AS BIGINT) AS target_rows, TRUE AS matches FROM {t}"
    for t in _S11_TABLES
)


@binding("s11_load_verify", S11_SQL)
def s11_load_verify(spark, sf_dir):
    """Copy every driver table (text, arrays and all) to the staging folder;
    compare the count observed during each write with the count read back
    from the written files. The copies go when the counts are known."""
    folder = staging_path(spark, "verified-load")
    try:
        return loads.copy_and_verify(spark, {t: _t(spark, sf_dir, t) for t in _S11_TABLES}, folder)
    finally:
        remove_folder(spark, folder)


# ======================================================================= S12
_S12_STATUS = ", ".join(f"'{v}'" for v in ORDER_STATUS_DOMAIN)
S12_SQL = f"""
SELECT 'region' AS table_name, 'done' AS phase, 'ok' AS status, CAST(COUNT(*) AS BIGINT) AS rows_read,
       CAST(COUNT(*) AS BIGINT) AS rows_loaded, CAST(0 AS BIGINT) AS rows_rejected, CAST(NULL AS VARCHAR) AS error
FROM region
UNION ALL
SELECT 'nation', 'done', 'ok', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR)
FROM nation
UNION ALL
SELECT 'orders', 'done', 'ok', CAST(COUNT(*) AS BIGINT),
       CAST(COUNT(*) FILTER (WHERE o_orderstatus IN ({_S12_STATUS})) AS BIGINT),
       CAST(COUNT(*) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ({_S12_STATUS})) AS BIGINT),
       CAST(NULL AS VARCHAR)
FROM orders
"""


@binding("s12_load_report", S12_SQL)
def s12_load_report(spark, sf_dir):
    """Multi-table load (gate → staged reload → verify) into a scratch schema;
    orders carries a status domain, so its out-of-domain rows are quarantined."""
    schema = _scratch_schema(spark, "load")

    def reader(name):
        return lambda s: read_table(s, sf_dir, name)

    specs = []
    for name in ("region", "nation", "orders"):
        df_schema = _t(spark, sf_dir, name).schema
        contract = _orders_contract(df_schema) if name == "orders" else contract_from_schema(name, df_schema)
        specs.append(loads.TableLoad(name, reader(name), contract))
    gate_folder = staging_path(spark, "gate")
    try:
        return loads.load_tables(spark, specs, schema, gate_folder)
    finally:
        _drop_scratch(spark, schema, gate_folder)


# ======================================================================== M5
_ORDERS_PROFILE = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                   ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
_DOCUMENTS_PROFILE = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                      ("n_chars", "bigint")]


def _m5_sql(table: str, columns) -> str:
    parts = []
    for i, (c, t) in enumerate(columns, start=1):
        if t == "double":
            mn = f"CAST(CAST(MIN({c}) AS DECIMAL(38,6)) AS VARCHAR)"
            mx = f"CAST(CAST(MAX({c}) AS DECIMAL(38,6)) AS VARCHAR)"
        else:
            mn, mx = f"CAST(MIN({c}) AS VARCHAR)", f"CAST(MAX({c}) AS VARCHAR)"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS ordinal, '{t}' AS data_type, "
            f"CAST(COUNT(*) AS BIGINT) AS row_count, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count, "
            f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS distinct_count, {mn} AS min_value, {mx} AS max_value "
            f"FROM {table}"
        )
    return "\nUNION ALL\n".join(parts)


@binding("m5_profile_orders", _m5_sql("orders", _ORDERS_PROFILE))
def m5_profile_orders(spark, sf_dir):
    return profile(_t(spark, sf_dir, "orders"))


@binding("m5_profile_documents", _m5_sql("documents", _DOCUMENTS_PROFILE))
def m5_profile_documents(spark, sf_dir):
    """Profile of the documents table: distinct counts and min/max over whole
    texts (byte order, as both engines compare text)."""
    return profile(_t(spark, sf_dir, "documents"))


# ======================================================================== M4
M4_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count, "
    f"(SELECT CAST(COUNT(*) AS INTEGER) FROM information_schema.columns WHERE table_name = '{t}') AS num_columns "
    f"FROM {t}"
    for t in DRIVER_TABLES
)


@binding("m4_table_stats", M4_SQL)
def m4_table_stats(spark, sf_dir):
    """The statistics ``describe_table`` reports, for every driver table: row
    count from one pass over per-file metadata, and the column count."""
    parts = []
    for t in DRIVER_TABLES:
        df = _t(spark, sf_dir, t)
        parts.append(catalog.table_stats(df).select(
            F.lit(t).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("int").alias("num_columns")
        ))
    return quality.union_reports(parts)


# ======================================================================== M6
@binding("m6_list_files")
def m6_list_files(spark, sf_dir):
    """Direct children of the data folder (the table files). No oracle: DuckDB
    sees no file system listing here."""
    return files.list_files(spark, sf_dir)


# ======================================================================== Q1
Q1_MAX_ROWS = 100
Q1_SQL = f"""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT {Q1_MAX_ROWS}
"""


@binding("q1_bounded_orders", Q1_SQL)
def q1_bounded_orders(spark, sf_dir):
    """The bounded SQL path: fetch n+1 rows in a scoped session, keep n, report
    truncation. The ≤ n rows are returned as a DataFrame."""
    stmt = (
        "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders "
        "ORDER BY o_totalprice DESC, o_orderkey"
    )
    res = bounded_sql.execute_sql(
        spark, stmt, max_rows=Q1_MAX_ROWS, views={"orders": table_path(sf_dir, "orders")}
    )
    schema = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").schema
    return spark.createDataFrame([tuple(r) for r in res.rows], schema)


# ======================================================================== P1
P1_PARAMS = '{"status": "F", "min_total": 250000}'
P1_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice >= 250000
"""


@binding("p1_param_run_orders", P1_SQL)
def p1_param_run_orders(spark, sf_dir):
    """A parameterised step run through the ledger: JSON params bound as named
    markers, result written to the staging folder, run recorded."""
    root = staging_path(spark, "ledger")
    path = table_path(sf_dir, "orders").replace("`", "``")
    stmt = (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate "
        f"FROM parquet.`{path}` WHERE o_orderstatus = :status AND o_totalprice >= :min_total"
    )
    run = ledger.run_job(spark, f"{root}/ledger", 102, stmt, P1_PARAMS, f"{root}/out", "orders by status")
    if run.get("state") != "SUCCESS":
        raise RuntimeError(f"run failed: {run}")
    return spark.read.parquet(run["output_path"])


# ======================================================================== P2
P2_SQL = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC,
                               event_type DESC, value DESC, props DESC) AS rn
  FROM events) WHERE rn = 1
"""


@binding("p2_latest_event_per_user", P2_SQL)
def p2_latest_event_per_user(spark, sf_dir):
    return latest_per_key(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


# ======================================================================== P3
P3_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
"""


@binding("p3_top_orders", P3_SQL)
def p3_top_orders(spark, sf_dir):
    return (
        _t(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))
        .limit(25)
    )


# ============================================================ P2, P3 on a ledger
def _events_ledger(spark, sf_dir) -> DataFrame:
    """The events as ledger rows: a user is a run of job (user modulo 40), purchases and
    errors end it, other kinds find it running."""
    kind, job = F.col("event_type"), F.col("user_id") % 40
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("run_id"),
        job.cast("bigint").alias("job_id"),
        F.concat(F.lit("job-"), job.cast("string")).alias("job_name"),
        F.col("props").alias("params"),
        F.when(kind.isin("purchase", "error"), "TERMINATED").otherwise("RUNNING").alias("state"),
        F.when(kind == "purchase", "SUCCESS").when(kind == "error", "FAILED").alias("result_state"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_id").cast("bigint").alias("event_seq"),
        F.when(kind == "purchase", F.col("event_id").cast("bigint")).alias("rows_written"),
        F.concat(F.lit("/runs/"), F.col("user_id").cast("string")).alias("output_path"),
        F.when(kind == "error", kind).alias("error"),
    )


_LEDGER_CTE = """
l AS (
  SELECT CAST(user_id AS BIGINT) AS run_id, CAST(user_id % 40 AS BIGINT) AS job_id,
         'job-' || CAST(user_id % 40 AS VARCHAR) AS job_name, props AS params,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'TERMINATED' ELSE 'RUNNING' END AS state,
         CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' END AS result_state,
         ts AS event_ts, event_id AS event_seq,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id AS BIGINT) END AS rows_written,
         '/runs/' || CAST(user_id AS VARCHAR) AS output_path,
         CASE WHEN event_type = 'error' THEN event_type END AS error
  FROM events),
n AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_ts DESC, event_seq DESC) AS rn,
         min(event_ts) OVER (PARTITION BY run_id) AS start_time
  FROM l),
runs AS (
  SELECT run_id, job_id, job_name, params, state AS life_cycle_state, result_state, start_time,
         CASE WHEN state <> 'RUNNING' THEN event_ts END AS end_time,
         CASE WHEN state <> 'RUNNING' THEN epoch(event_ts) - epoch(start_time) END AS duration_seconds,
         rows_written, output_path, error
  FROM n WHERE rn = 1)
"""


@binding("p2_job_runs", f"WITH {_LEDGER_CTE} SELECT * FROM runs")
def p2_job_runs(spark, sf_dir):
    runs = ledger.job_runs(_events_ledger(spark, sf_dir))
    return runs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})


P3_JOBS_SQL = f"""
WITH {_LEDGER_CTE},
jobs AS (
  SELECT job_id, max(job_name) AS name, CAST(count(*) AS BIGINT) AS runs, max(start_time) AS last_run_at
  FROM runs GROUP BY job_id)
SELECT *, (SELECT count(*) FROM jobs) > 25 AS more_jobs FROM jobs ORDER BY job_id LIMIT 25
"""


@binding("p3_list_jobs", P3_JOBS_SQL)
def p3_list_jobs(spark, sf_dir):
    jobs = ledger.first_jobs(_events_ledger(spark, sf_dir))
    return jobs.withColumn("last_run_at", F.col("last_run_at").cast("timestamp_ntz"))


# ============================================================ Q1 statement kinds
# Statements of other kinds routed through the bounded-SQL path (SURVEY §2.7:
# set operations, range joins, outer joins pass through Q1 unchanged). Each
# reads whole tables and reduces them to a few rows, so the row cap never cuts
# the answer; ``truncated`` stays false.
def _bounded_binding(name: str, statement: str, tables: tuple[str, ...]):
    def run(spark, sf_dir):
        res = bounded_sql.execute_sql(
            spark, statement, max_rows=bounded_sql.MAX_ROWS_CAP,
            views={t: table_path(sf_dir, t) for t in tables},
        )
        if res.truncated:
            raise RuntimeError(f"{name}: result exceeded {bounded_sql.MAX_ROWS_CAP} rows")
        return spark.createDataFrame([tuple(r) for r in res.rows], res.schema)

    run.__name__ = name
    binding(name, statement)(run)
    return run


Q1_SET_OPS_SQL = """
SELECT 'union' AS op, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) u
UNION ALL
SELECT 'intersect', CAST(COUNT(*) AS BIGINT) FROM (
  SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) i
UNION ALL
SELECT 'customers_without_orders', CAST(COUNT(*) AS BIGINT) FROM (
  SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) e
UNION ALL
SELECT 'union_all', CAST(COUNT(*) AS BIGINT) FROM (
  SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) a
"""
_bounded_binding("q1_set_ops", Q1_SET_OPS_SQL, ("orders", "customer"))

Q1_RANGE_JOIN_SQL = """
SELECT o_orderpriority AS channel,
       CAST(COUNT(*) AS BIGINT) AS lines_within_30_days,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS amount
FROM lineitem JOIN orders
  ON l_orderkey = o_orderkey
 AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY
GROUP BY o_orderpriority
"""
_bounded_binding("q1_range_join", Q1_RANGE_JOIN_SQL, ("lineitem", "orders"))

Q1_FULL_OUTER_SQL = """
SELECT CASE WHEN c.c_custkey IS NULL THEN 'order_only'
            WHEN o.o_custkey IS NULL THEN 'customer_only' ELSE 'both' END AS side,
       CAST(COUNT(*) AS BIGINT) AS n
FROM customer c FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c.c_custkey = o.o_custkey
GROUP BY 1
"""
_bounded_binding("q1_full_outer", Q1_FULL_OUTER_SQL, ("customer", "orders"))


Q1_BAND_JOIN_SQL = """
SELECT b.band,
       CAST(COUNT(*) AS BIGINT) AS lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS amount
FROM lineitem
JOIN (VALUES ('a: under 1k', CAST(0 AS DOUBLE), CAST(1000 AS DOUBLE)),
             ('b: 1k-10k', CAST(1000 AS DOUBLE), CAST(10000 AS DOUBLE)),
             ('c: 10k-50k', CAST(10000 AS DOUBLE), CAST(50000 AS DOUBLE)),
             ('d: 50k and more', CAST(50000 AS DOUBLE), CAST(1e300 AS DOUBLE))) AS b(band, lo, hi)
  ON l_extendedprice >= b.lo AND l_extendedprice < b.hi
GROUP BY b.band
"""
# A theta (non-equi) join: each line meets exactly one band of a four-row
# inline table, so the output grows with lineitem, never with pairs.
_bounded_binding("q1_band_join", Q1_BAND_JOIN_SQL, ("lineitem",))


# ======================================================================== Q3
Q3_SQL = """
SELECT o_orderkey,
       CAST(to_json(struct_pack(o_orderkey := o_orderkey, o_orderstatus := o_orderstatus,
                                o_totalprice := o_totalprice, o_orderpriority := o_orderpriority)) AS VARCHAR) AS json
FROM orders
"""


@binding("q3_json_rows", Q3_SQL)
def q3_json_rows(spark, sf_dir):
    """Result rows rendered as JSON objects on the executors."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return bounded_sql.result_json_rows(o, keep=["o_orderkey"])


# ================================================================ S5+S2+S12
@binding("s12_csv_migration", S12_SQL)
def s12_csv_migration(spark, sf_dir):
    """The CSV migration end to end: export region, nation and orders to a CSV
    folder, then load the folder into contract tables (typed read, gate,
    staged reload, verification). Same report as ``s12_load_report``."""
    from lakeaudit.plans import migrate

    names = ("region", "nation", "orders")
    frames = {n: _t(spark, sf_dir, n) for n in names}
    folder = staging_path(spark, "csv-export")
    migrate.export_csv(spark, frames, folder)
    contracts = [
        _orders_contract(frames[n].schema) if n == "orders" else contract_from_schema(n, frames[n].schema)
        for n in names
    ]
    schema = f"la_mig_{uuid.uuid4().hex[:10]}"
    try:
        return migrate.migrate_csv(
            spark, folder, schema, contracts, schema_location=staging_path(spark, schema), multi_line=False
        )
    finally:
        _drop_scratch(spark, schema, folder)
