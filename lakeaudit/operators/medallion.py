"""Bronze → silver → gold datasets.

The reference names these datasets and jobs and describes two of them column
by column; it computes none of them. The formulas below are ours and every
column name is a parameter, so the same code runs on the medallion contracts
and on the driver's tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.money import money, money_sum, rate
from lakeaudit.operators.segmented import latest_per_key, range_blocks, running_sum_blocked, time_block


# --------------------------------------------------------------------------- G3
def silver_dedupe(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """Keep the last row per key by ``order`` (e.g. ``updated_at``); the other
    columns break ties so reruns pick the same row. Aggregation, not a window,
    so a hot key is combined map-side."""
    return latest_per_key(df, key, order)


def normalise_status(df: DataFrame, column: str = "status") -> DataFrame:
    """``lower(trim(status))``."""
    return df.withColumn(column, F.lower(F.trim(F.col(column))))


def silver_orders(
    df: DataFrame,
    key: str = "order_id",
    order: Sequence[str] = ("updated_at",),
    status: str = "status",
    domain: Sequence[str] | None = ("pending", "shipped", "delivered", "cancelled"),
) -> tuple[DataFrame, DataFrame]:
    """Silver orders: latest row per key, status normalised, rows outside the
    status domain moved to a quarantine frame. Returns ``(good, quarantined)``;
    both derive from one deduplicated plan."""
    deduped = normalise_status(silver_dedupe(df, key, list(order)), status)
    if not domain:
        return deduped, deduped.limit(0)
    ok = F.col(status).isin(list(domain))
    return deduped.filter(ok), deduped.filter(~ok | F.col(status).isNull())


def write_silver(good: DataFrame, path: str, partition_by: Sequence[str] = ("order_date",)) -> None:
    """Write silver rows partitioned by the contract's partition columns;
    a rerun replaces only the partitions present in ``good``."""
    (
        good.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


# --------------------------------------------------------------------------- G4
def line_totals(
    lines: DataFrame,
    order_key: str = "l_orderkey",
    price: str = "l_extendedprice",
    discount: str = "l_discount",
    tax: str | None = "l_tax",
) -> DataFrame:
    """Per-order money from its lines, in DECIMAL: gross Σ price, net
    Σ price·(1−discount), charge Σ price·(1−discount)·(1+tax), line count.

    Aggregating lines to one row per order *before* joining orders makes the
    join 1:1 on the order key; the partial aggregate also collapses a hot
    order map-side."""
    p = money(price)
    d = rate(discount)
    net = p * (F.lit(1) - d)
    aggs = [
        money_sum(p, 22, 2).alias("gross"),
        money_sum(net, 26, 4).alias("net"),
        F.count(F.lit(1)).alias("line_count"),
    ]
    if tax:
        aggs.append(money_sum(net * (F.lit(1) + rate(tax)), 30, 6).alias("charge"))
    return lines.groupBy(F.col(order_key).alias("order_key")).agg(*aggs)


def daily_revenue(
    orders: DataFrame,
    lines: DataFrame,
    order_key: str = "o_orderkey",
    order_ts: str = "o_orderdate",
    channel: str = "o_orderpriority",
    line_order_key: str = "l_orderkey",
    price: str = "l_extendedprice",
    discount: str = "l_discount",
) -> DataFrame:
    """gold.daily_revenue: per day and channel, gross = Σ price, net =
    Σ price·(1−discount), order_count = distinct orders with lines.

    Plan: lines → partial+final aggregate per order (one shuffle, hash on the
    order key) → inner join orders on that key (orders shuffled once; the
    aggregated side keeps its partitioning) → aggregate per (day, channel),
    whose output is tiny. ``order_count`` is ``count(*)`` because the join
    leaves one row per order, which avoids a distinct aggregate."""
    per_order = line_totals(lines, line_order_key, price, discount, tax=None)
    o = orders.select(
        F.col(order_key).alias("order_key"),
        F.to_date(F.col(order_ts)).alias("revenue_date"),
        F.col(channel).alias("channel"),
    )
    joined = o.join(per_order, "order_key")
    return joined.groupBy("revenue_date", "channel").agg(
        F.sum("gross").cast("decimal(22,2)").alias("gross_revenue"),
        F.sum("net").cast("decimal(26,4)").alias("net_revenue"),
        F.count(F.lit(1)).cast("bigint").alias("order_count"),
    )


# --------------------------------------------------------------------------- G5
def lifetime_value(
    users: DataFrame,
    orders: DataFrame,
    user_key: str = "c_custkey",
    order_user: str = "o_custkey",
    amount: str = "o_totalprice",
    order_ts: str = "o_orderdate",
    user_cols: Sequence[str] = (),
) -> DataFrame:
    """gold.user_lifetime_value: per user the order count, Σ amount (DECIMAL),
    first and last order time. Users without orders are kept with 0 and NULLs.

    Orders are aggregated per user first (map-side combine), then the user
    table is left-joined to that aggregate 1:1."""
    per_user = orders.groupBy(F.col(order_user).alias("_u")).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(money(amount)).alias("lifetime_amount"),
        F.min(order_ts).alias("first_order_at"),
        F.max(order_ts).alias("last_order_at"),
    )
    u = users.select(F.col(user_key), *user_cols)
    joined = u.join(per_user, u[user_key] == per_user["_u"], "left").drop("_u")
    return joined.select(
        user_key,
        *user_cols,
        F.coalesce("order_count", F.lit(0)).cast("bigint").alias("order_count"),
        F.coalesce("lifetime_amount", F.lit(0)).cast("decimal(22,2)").alias("lifetime_amount"),
        "first_order_at",
        "last_order_at",
    )


def running_amount(
    orders: DataFrame,
    user: str = "o_custkey",
    order: Sequence[str] = ("o_orderdate", "o_orderkey"),
    amount: str = "o_totalprice",
    block_seconds: int | None = None,
    rows_per_block: int = 1 << 20,
) -> DataFrame:
    """Running Σ amount per user along ``order`` (rows frame), in DECIMAL.
    Computed per (user, time block) so one very active user does not land in a
    single task; ``order`` must be total within a user. The blocks
    are cut by the rows' ranges (``range_blocks``) unless ``block_seconds`` is given;
    when no user exceeds ``rows_per_block`` rows, a plain window is used."""
    ts = order[0]
    if block_seconds:
        blocked, block = orders, time_block(F.col(ts), block_seconds)
    else:
        blocked, block = range_blocks(orders, user, order, rows_per_block)
    return running_sum_blocked(
        blocked, user, list(order), money(amount), block, out="running_amount"
    ).withColumn("running_amount", F.col("running_amount").cast("decimal(22,2)"))


# --------------------------------------------------------------------------- G6
def funnel(
    events: DataFrame,
    steps: Sequence[str],
    user: str = "user_id",
    ts: str = "ts",
    kind: str = "event_type",
    salts: int = 16,
) -> DataFrame:
    """gold.funnel_summary: users reaching each ordered step.

    Step 1 is a user's first event of ``steps[0]``; step k is reached at the
    user's first ``steps[k-1]`` event at or after step k−1's time. Each step is
    one aggregate per user over that step's events inner-joined to the previous
    step's per-user times. The events of a user are dealt over ``salts`` parts
    by their time and the small per-user side is copied to each part, so a very
    active user is joined in as many tasks and combined there before the
    aggregate's shuffle. The final counts reference each step's time column, so each step's
    plan appears once and its shuffle is reused rather than recomputed.
    Returns ``(step_no, step_name, users)``.
    """
    # Events without a user or a time cannot be followed through the steps.
    # Filtering them here also makes every step's plan carry the same filters
    # the joins would infer, so Spark reuses each step's shuffle in the counts.
    relevant = events.filter(
        F.col(kind).isin(list(steps)) & F.col(user).isNotNull() & F.col(ts).isNotNull()
    ).select(user, ts, kind, F.pmod(F.xxhash64(ts), F.lit(salts)).alias("_salt"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    reached = relevant.filter(F.col(kind) == steps[0]).groupBy(user).agg(F.min(ts).alias("t"))
    per_step = [reached]
    for step in steps[1:]:
        prev = reached.select(user, F.col("t").alias("_prev"), every.alias("_salt"))
        cand = relevant.filter(F.col(kind) == step).join(prev, [user, "_salt"])
        reached = cand.filter(F.col(ts) >= F.col("_prev")).groupBy(user).agg(F.min(ts).alias("t"))
        per_step.append(reached)
    tagged = None
    for i, (step, r) in enumerate(zip(steps, per_step), start=1):
        part = r.select(F.lit(i).cast("int").alias("step_no"), F.lit(step).alias("step_name"), "t")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("step_no", "step_name").agg(F.count("t").cast("bigint").alias("users"))


# --------------------------------------------------------------------------- G8
def user_features(
    events: DataFrame,
    kinds: Sequence[str],
    user: str = "user_id",
    kind: str = "event_type",
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Per-user feature row: count and Σ value (DECIMAL) per event kind from a
    fixed list (so the schema never depends on the data), total count, first
    and last seen time, mean gap between consecutive events. One aggregate,
    map-side combined (the conditional aggregates are the fixed-value pivot)."""
    aggs = []
    for k in kinds:
        hit = F.col(kind) == F.lit(k)
        aggs.append(F.count(F.when(hit, F.lit(1))).cast("bigint").alias(f"n_{k}"))
        aggs.append(
            F.coalesce(F.sum(F.when(hit, money(value))), F.lit(0))
            .cast("decimal(22,2)")
            .alias(f"value_{k}")
        )
    aggs.append(F.count(F.lit(1)).cast("bigint").alias("n_events"))
    aggs.append(F.min(ts).alias("first_seen"))
    aggs.append(F.max(ts).alias("last_seen"))
    out = events.groupBy(user).agg(*aggs)
    # The mean gap between a user's consecutive events (a lag feature) needs
    # no window: the gaps telescope, so their sum is last − first.
    span_us = F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(
        F.col("first_seen").cast("timestamp")
    )
    mean_gap = F.when(
        F.col("n_events") > 1,
        span_us.cast("double") / F.lit(1e6) / (F.col("n_events") - 1).cast("double"),
    )
    return out.withColumn("mean_gap_seconds", mean_gap.cast("double"))
