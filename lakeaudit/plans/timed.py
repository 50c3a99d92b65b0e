"""Further bindings: operators that work along time (as-of and interval joins, two joined
streams, late events), the file-level load ledger, gold refreshes, and checks bound so that each
of their outcomes occurs. Conventions as in ``bindings``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeaudit.functions.money import money
from lakeaudit.operators import deadlines, gate, reconcile
from lakeaudit.operators.asof import asof_join
from lakeaudit.operators.conformance import conformance
from lakeaudit.operators.intervals import overlap_join
from lakeaudit.plans import loads
from lakeaudit.plans.bindings import DETECTED_AT, G4_SQL, _c1_frame, _orders_contract, _scratch_schema, _t, binding
from lakeaudit.plans.copy_into import copy_into, loaded
from lakeaudit.plans.gold import refresh_daily_revenue
from lakeaudit.session import staging_path
from lakeaudit.sources.swap import remove_folder
from lakeaudit.streaming import joins, late

QUOTE_DAYS = 180
VIEW_HOURS = 24
DELIVERY_DAYS = 60
DELAY_DAYS = 1
LATE_HOURS = 6
LANDINGS = 4


# ================================================= as-of joins
C5_ASOF_SQL = f"""
WITH quotes AS (
  SELECT l_partkey, l_shipdate, max({{'k': l_orderkey, 'n': l_linenumber, 'p': CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT)}}) AS q
  FROM lineitem WHERE l_returnflag = 'N' AND l_partkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY l_partkey, l_shipdate),
returned AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_cents
  FROM lineitem WHERE l_returnflag = 'R'),
held AS (
  SELECT r.*, CASE WHEN date_diff('day', quotes.l_shipdate, r.l_shipdate) <= {QUOTE_DAYS} THEN quotes.l_shipdate END AS quoted_at, quotes.q
  FROM returned r ASOF LEFT JOIN quotes ON r.l_partkey = quotes.l_partkey AND r.l_shipdate >= quotes.l_shipdate)
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, unit_cents, quoted_at,
       CASE WHEN quoted_at IS NOT NULL THEN q.p END AS quoted_cents,
       CASE WHEN quoted_at IS NOT NULL THEN unit_cents - q.p END AS drift_cents
FROM held
"""


@binding("c5_asof_quote", C5_ASOF_SQL)
def c5_asof_quote(spark, sf_dir):
    """Each returned line with the part's last quoted unit price at its ship date (C5 along time): the
    quote is that of the last unreturned line shipped no later, at most ``QUOTE_DAYS`` before."""
    lines = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag",
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("unit_cents"),
    )
    quotes = lines.where("l_returnflag = 'N'").select(
        "l_partkey", F.col("l_shipdate").alias("quoted_at"), F.struct("l_orderkey", "l_linenumber", "unit_cents").alias("quote")
    )
    held = asof_join(
        lines.where("l_returnflag = 'R'").drop("l_returnflag"), quotes, "l_partkey", "l_shipdate", "quoted_at", ["quoted_at", "quote"],
        tolerance=QUOTE_DAYS * 86_400,
    )
    return held.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "unit_cents", "quoted_at", F.col("quote.unit_cents").alias("quoted_cents"),
        (F.col("unit_cents") - F.col("quote.unit_cents")).alias("drift_cents"),
    )


G8_ASOF_SQL = f"""
WITH views AS (
  SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts),
bought AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT b.event_id, b.user_id, b.ts, CAST(b.value AS DECIMAL(12,2)) AS amount,
       CASE WHEN v.ts >= b.ts - INTERVAL {VIEW_HOURS} HOUR THEN v.view_id END AS view_id,
       CASE WHEN v.ts >= b.ts - INTERVAL {VIEW_HOURS} HOUR THEN v.ts END AS viewed_at
FROM bought b ASOF LEFT JOIN views v ON b.user_id = v.user_id AND b.ts >= v.ts
"""


@binding("g8_asof_last_view", G8_ASOF_SQL)
def g8_asof_last_view(spark, sf_dir):
    """Each purchase with the user's last view before it, at most ``VIEW_HOURS`` old: the feature as of that moment."""
    events = _t(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", money("value").alias("amount"))
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed_at"), F.col("event_id").alias("view_id"))
    return asof_join(bought, views, "user_id", "ts", "viewed_at", ["view_id", "viewed_at"], tolerance=VIEW_HOURS * 3_600)


# ============================================================ interval join
INTERVAL_SQL = """
WITH spans AS (
  SELECT event_id, event_type, ts AS opened, ts + to_microseconds(CAST(floor(value * 1000000) AS BIGINT)) AS closed FROM events)
SELECT e.event_id AS error_id, p.event_id AS purchase_id,
       greatest(e.opened, p.opened) AS overlap_from, least(e.closed, p.closed) AS overlap_to
FROM spans e JOIN spans p ON e.opened <= p.closed AND p.opened <= e.closed
WHERE e.event_type = 'error' AND p.event_type = 'purchase'
"""


@binding("c2_interval_incidents", INTERVAL_SQL)
def c2_interval_incidents(spark, sf_dir):
    """Purchases in progress during an error, whoever had it: both last ``value`` seconds from
    their time on. The pairs have no key in common, only overlapping intervals."""
    spans = _t(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("ts").alias("opened"),
        (F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 1_000_000).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)"))).alias("closed"),
    )
    pairs = overlap_join(
        spans.where("event_type = 'error'").select("event_id", "opened", "closed"), spans.where("event_type = 'purchase'").select("event_id", "opened", "closed"),
        ("opened", "closed"), ("opened", "closed"), left_prefix="e_", right_prefix="p_",
    )
    return pairs.select(
        F.col("e_event_id").alias("error_id"), F.col("p_event_id").alias("purchase_id"),
        F.greatest("e_opened", "p_opened").alias("overlap_from"), F.least("e_closed", "p_closed").alias("overlap_to"),
    )


# ================================================= two streams (C2, C3 live)
STREAM_JOIN_SQL = f"""
WITH mark AS (
  SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL {DELAY_DAYS} DAY AS t),
met AS (
  SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate FROM orders LEFT JOIN lineitem
    ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL {DELIVERY_DAYS} DAY)
SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate FROM met, mark
WHERE l_shipdate IS NOT NULL OR o_orderdate + INTERVAL {DELIVERY_DAYS} DAY < mark.t
"""


@binding("c3_stream_undelivered", STREAM_JOIN_SQL)
def c3_stream_undelivered(spark, sf_dir):
    """Orders and deliveries as two streams: every delivery within ``DELIVERY_DAYS`` of its order, and the orders
    without one whose time has run out by the watermark."""
    out = staging_path(spark, "undelivered")
    schemas = {name: _t(spark, sf_dir, name).schema for name in ("orders", "lineitem")}
    columns = ["o_orderkey", "o_orderdate", "l_linenumber", "l_shipdate"]
    joins.joined_ingest(
        spark, (sf_dir, schemas["orders"], "orders.parquet"), (sf_dir, schemas["lineitem"], "lineitem.parquet"), f"{out}/sink", f"{out}/checkpoint",
        [("o_orderkey", "l_orderkey")], "o_orderdate", "l_shipdate", f"{DELIVERY_DAYS} days", f"{DELAY_DAYS} days", f"{DELAY_DAYS} days", columns,
    )
    return spark.read.parquet(f"{out}/sink").select(*columns)


# ========================================================= late events (G1)
# An event lands with a delay of 0 to 7 hours made from its id; landings are equal spans of the landing time.
_LANDED = "unix_micros(CAST(ts AS TIMESTAMP)) + (event_id % 8) * 3600 * CAST(1000000 AS BIGINT)"
LATE_SQL = f"""
WITH landed AS (SELECT *, epoch_us(ts) + (event_id % 8) * 3600 * CAST(1000000 AS BIGINT) AS came FROM events),
ends AS (SELECT min(came) AS lo, max(came) AS hi FROM landed),
dealt AS (SELECT landed.*, least((came - lo) * {LANDINGS} // (hi - lo + 1), {LANDINGS} - 1) AS landing FROM landed, ends),
newest AS (SELECT landing, max(max(ts)) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM dealt GROUP BY landing)
SELECT event_id, user_id, ts, event_type, CAST(landing AS BIGINT) AS batch,
       CASE WHEN seen IS NOT NULL AND ts < seen - INTERVAL {LATE_HOURS} HOUR THEN 'late' ELSE 'on_time' END AS route
FROM dealt JOIN newest USING (landing)
"""


@binding("g1_late_events", LATE_SQL)
def g1_late_events(spark, sf_dir):
    """Events that land in ``LANDINGS`` portions, some hours late, each routed to exactly one of the two
    outputs; the outputs are read back with their batch."""
    events = _t(spark, sf_dir, "events")
    out = staging_path(spark, "late-events")
    landed = events.withColumn("at", F.expr(_LANDED))
    lo, hi = landed.agg(F.min("at"), F.max("at")).first()
    if lo is None:
        lo = hi = 0
    dealt = landed.withColumn("landing", F.least(F.expr(f"(at - {lo}L) * {LANDINGS} div {hi - lo + 1}L"), F.lit(LANDINGS - 1)))
    for portion in range(LANDINGS):  # each landing is a run of the schedule
        dealt.where(F.col("landing") == portion).drop("at", "landing").write.mode("append").parquet(f"{out}/landing")
        late.split_late(spark, f"{out}/landing", events.schema, f"{out}/sink", f"{out}/checkpoint", "ts", LATE_HOURS * 3_600)
    names = ["event_id", "user_id", "ts", "event_type", "batch"]
    routes = [late.routed_rows(spark, f"{out}/sink", r, events.schema).select(*names, F.lit(r).alias("route")) for r in (late.ON_TIME, late.LATE)]
    return routes[0].unionByName(routes[1])


# =============================================== file-level load ledger
_STEP = "SELECT '{step}' AS step, {seen} AS files_seen, {loaded} AS files_loaded, {rows} AS rows_loaded, {held} AS table_rows, {total} AS table_total FROM g"
_FIRST, _ALL = "p < '4'", "TRUE"


def _step(step: str, seen: str, loaded_: str) -> str:
    files = "CAST(count(*) FILTER ({}) AS BIGINT)".format
    rows = "CAST(coalesce(sum(n) FILTER ({}), 0) AS BIGINT)".format
    total = f"CAST(sum(total) FILTER ({seen}) AS DECIMAL(24,2))"
    return _STEP.format(step=step, seen=files(seen), loaded=files(loaded_), rows=rows(loaded_), held=rows(seen), total=total)


COPY_SQL = f"""
WITH g AS (
  SELECT o_orderpriority AS p, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders GROUP BY o_orderpriority)
{_step("1 first files", _FIRST, _FIRST)} UNION ALL {_step("2 again", _FIRST, "FALSE")}
UNION ALL {_step("3 new files", _ALL, f"NOT ({_FIRST})")} UNION ALL {_step("4 forced", _ALL, _ALL)}
"""


@binding("s9_copy_into", COPY_SQL)
def s9_copy_into(spark, sf_dir):
    """Orders land as one file per priority, some later than others; four loads: the first files, the same again, the
    new ones only, and all by force. Each step tells what it loaded and what the table then holds."""
    out = staging_path(spark, "copy-into")
    orders = _t(spark, sf_dir, "orders")
    schema = orders.schema
    steps = (("1 first files", "o_orderpriority < '4'", False), ("2 again", None, False), ("3 new files", "o_orderpriority >= '4'", False), ("4 forced", None, True))
    report = []
    for step, fresh, force in steps:
        if fresh:
            part = orders.where(fresh)
            part.withColumn("p", F.col("o_orderpriority")).repartition("p").write.mode("append").partitionBy("p").parquet(f"{out}/landing")
        did = copy_into(spark, f"{out}/landing", f"{out}/table", schema, pattern="*.parquet", force=force)
        held = loaded(spark, f"{out}/table", schema).agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).cast("decimal(24,2)").alias("total")).first()
        report.append((step, did["files_seen"], did["files_loaded"], did["rows_loaded"], held["n"], held["total"]))
    remove_folder(spark, out)
    return spark.createDataFrame(
        report, "step string, files_seen long, files_loaded long, rows_loaded long, table_rows long, table_total decimal(24,2)"
    )


# ================================================== gold refresh (G4), S9, S3
GOLD_SINCE = dt.date(1998, 7, 15)


@binding("g4_gold_refresh", f"SELECT *, strftime(revenue_date, '%Y-%m') AS revenue_month FROM ({G4_SQL})")
def g4_gold_refresh(spark, sf_dir):
    """The gold table written without the orders of the last months' second halves, then refreshed twice from
    ``GOLD_SINCE`` on: it holds the revenue of all orders."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    table = f"{_scratch_schema(spark, 'gold')}.daily_revenue"
    early = orders.where((F.col("o_orderdate") < F.lit(GOLD_SINCE.replace(day=1))) | (F.dayofmonth("o_orderdate") < 15))
    refresh_daily_revenue(spark, early, lines, table)
    for _ in range(2):
        refresh_daily_revenue(spark, orders, lines, table, GOLD_SINCE)
    return spark.table(table)


@binding("s9_overwrite_partitions", "SELECT * FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000")
def s9_overwrite_partitions(spark, sf_dir):
    """All orders by status; then one status is replaced by its larger orders, and the other partitions stay."""
    orders, table = _t(spark, sf_dir, "orders"), f"{_scratch_schema(spark, 'partitions')}.orders"
    loads.reload_table(spark, orders, table, ["o_orderstatus"])
    loads.overwrite_partitions(spark, orders.where("o_orderstatus = 'F' AND o_totalprice > 100000"), table)
    return spark.table(table).select(*orders.columns)


S3_ABSENT_SQL = """
SELECT o_orderkey, 'absent:o_totalprice' AS reason FROM orders
UNION ALL SELECT o_orderkey, 'domain:o_orderstatus' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
"""


@binding("s3_gate_absent_column", S3_ABSENT_SQL)
def s3_gate_absent_column(spark, sf_dir):
    """Orders that come without their price: the contract says NOT NULL, so every row is rejected for it, beside its other reasons."""
    orders = _t(spark, sf_dir, "orders")
    tagged = gate.tag(orders.drop("o_totalprice"), _orders_contract(orders.schema))
    return gate.reason_rows(tagged, ["o_orderkey"])


# ============================ checks of which every outcome occurs
WIDE_TOLERANCE = 50_000
C1_WIDE_SQL = f"""
WITH per_order AS (
  SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))
         * (1 + CAST(l_tax AS DECIMAL(12,2)))) AS DECIMAL(30,6)) AS charge FROM lineitem GROUP BY l_orderkey),
d AS (SELECT o_orderkey, abs(charge - CAST(o_totalprice AS DECIMAL(12,2))) > {WIDE_TOLERANCE} AS off FROM orders JOIN per_order ON o_orderkey = l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, off AS flagged FROM d
"""


@binding("c1_reconcile_tolerance", C1_WIDE_SQL)
def c1_reconcile_tolerance(spark, sf_dir):
    """Every order with lines, and whether its total is off by more than ``WIDE_TOLERANCE``: some are and some are not."""
    frame = _c1_frame(spark, sf_dir)
    rule = reconcile.Rule("TOTAL_MISMATCH", money("o_totalprice"), F.col("charge").cast("decimal(30,6)"), WIDE_TOLERANCE, "order total differs from the sum of its line charges")
    flagged = reconcile.reconcile(frame, "order_key", [rule], DETECTED_AT).select("tx_id", F.lit(True).alias("flagged"))
    seen = frame.select(F.col("order_key").cast("string").alias("tx_id"))
    return seen.join(flagged, "tx_id", "left").select("tx_id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


RECEIPT_DAYS = 90
C4_ALL_SQL = f"""
WITH f AS (SELECT l_orderkey, MIN(l_shipdate) AS receipt_sent_at, MAX(l_shipdate) - INTERVAL 60 DAY AS cancellation_deadline FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey AS tx_id, o_orderdate AS disclosed_at, receipt_sent_at, cancellation_deadline FROM orders LEFT JOIN f ON o_orderkey = l_orderkey)
SELECT *, 'receipt_missing' AS check_name FROM b WHERE receipt_sent_at IS NULL
UNION ALL SELECT *, 'receipt_late' FROM b WHERE receipt_sent_at > disclosed_at + INTERVAL {RECEIPT_DAYS} DAY
UNION ALL SELECT *, 'deadline_invalid' FROM b WHERE cancellation_deadline < disclosed_at
"""


@binding("c4_receipt_checks_all", C4_ALL_SQL)
def c4_receipt_checks_all(spark, sf_dir):
    """As ``c4_receipt_checks``, with the cancellation deadline 60 days before the last ship date: all three checks fire."""
    shipped = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("receipt_sent_at"), (F.max("l_shipdate") - F.make_dt_interval(days=F.lit(60))).alias("cancellation_deadline")
    )
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.col("o_orderdate").alias("disclosed_at"))
    joined = orders.join(shipped, F.col("tx_id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return deadlines.receipt_checks(joined, receipt_limit_seconds=RECEIPT_DAYS * 86_400, keep=["tx_id"])


# ======================================================= trail conformance
#: A purchase follows a click, a click follows a view; errors may come at any time, sign-ups only between visits.
SHOP_FLOW = {
    ("idle", "view"): "viewing", ("idle", "signup"): "idle", ("idle", "error"): "idle",
    ("viewing", "view"): "viewing", ("viewing", "click"): "clicked", ("viewing", "error"): "viewing",
    ("clicked", "click"): "clicked", ("clicked", "view"): "viewing", ("clicked", "purchase"): "idle", ("clicked", "error"): "clicked",
}
_NEXT = " ".join(f"WHEN acc.s = '{s}' AND x.e = '{e}' THEN '{to}'" for (s, e), to in SHOP_FLOW.items())
C6_FLOW_SQL = f"""
WITH listed AS (
  SELECT user_id, list({{'s': 'idle', 'e': event_type, 'n': CAST(0 AS BIGINT), 't': ts, 'i': event_id, 'ft': CAST(NULL AS TIMESTAMP), 'fi': CAST(NULL AS BIGINT)}} ORDER BY ts, event_id) AS events
  FROM events GROUP BY user_id),
ended AS (
  SELECT user_id, len(events) AS n_events, list_reduce(
    list_concat([{{'s': 'idle', 'e': '', 'n': CAST(0 AS BIGINT), 't': CAST(NULL AS TIMESTAMP), 'i': CAST(NULL AS BIGINT), 'ft': CAST(NULL AS TIMESTAMP), 'fi': CAST(NULL AS BIGINT)}}], events),
    lambda acc, x: {{'s': CASE {_NEXT} ELSE acc.s END, 'e': x.e,
      'n': acc.n + CASE WHEN (CASE {_NEXT} END) IS NULL THEN 1 ELSE 0 END, 't': x.t, 'i': x.i,
      'ft': CASE WHEN acc.fi IS NULL AND (CASE {_NEXT} END) IS NULL THEN x.t ELSE acc.ft END,
      'fi': CASE WHEN acc.fi IS NULL AND (CASE {_NEXT} END) IS NULL THEN x.i ELSE acc.fi END}}) AS r
  FROM listed)
SELECT user_id, CAST(n_events AS BIGINT) AS n_events, r.n AS n_violations, r.ft AS first_bad_ts, r.fi AS first_bad_event, r.s AS end_state FROM ended
"""


@binding("c6_conformance_events", C6_FLOW_SQL)
def c6_conformance_events(spark, sf_dir):
    """Each user's trail of events against ``SHOP_FLOW``: how many events come out of turn, the first of them, and the state at the end."""
    judged = conformance(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", SHOP_FLOW, "idle")
    return judged.select(
        "user_id", "n_events", "n_violations", F.col("first_violation.ts").alias("first_bad_ts"), F.col("first_violation.event_id").alias("first_bad_event"), "end_state"
    )
