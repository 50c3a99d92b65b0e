"""Violation summaries (C8), customer risk exposure (C9), payload fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.json import extract_json_fields, json_is_valid


def violation_summary(
    violations: DataFrame,
    dims: Sequence[str] = ("severity", "rule_id", "corridor"),
    mode: str = "rollup",
    grouping_sets: Sequence[Sequence[str]] | None = None,
    amount: str = "delta",
) -> DataFrame:
    """Violation count and Σ|delta| by ``dims`` with subtotals.

    ``mode`` is ``rollup``, ``cube`` or ``sets`` (explicit ``grouping_sets``).
    One ``g_<dim>`` flag per dimension (1 = rolled up) tells a subtotal's NULL
    from a real NULL. The violations are first aggregated to the finest groups; only
    those few rows are expanded into the sets.
    """
    violations = violations.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs(F.col(amount))).alias("_abs")
    )
    aggs = [
        F.sum("_n").cast("bigint").alias("violations"),
        F.sum("_abs").cast("decimal(22,6)").alias("abs_delta"),
    ]
    flags = [F.grouping(d).cast("int").alias(f"g_{d}") for d in dims]
    if mode == "rollup":
        grouped = violations.rollup(*dims)
    elif mode == "cube":
        grouped = violations.cube(*dims)
    elif mode == "sets":
        if not grouping_sets:
            raise ValueError("mode='sets' needs grouping_sets")
        grouped = violations.groupingSets([list(s) for s in grouping_sets], *dims)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return grouped.agg(*aggs, *flags)


def risk_exposure(
    customers: DataFrame,
    transactions: DataFrame,
    violations: DataFrame,
    tier_cols: Sequence[str] = ("kyc_tier", "risk_level"),
    customer_key: str = "customer_id",
    tx_key: str = "tx_id",
    amount: str = "send_amount",
) -> DataFrame:
    """Per customer tier, total and violating amount and the violating share.

    Violations are reduced to distinct violating tx ids (aggregate, map-side
    combined) and left-joined 1:1 to transactions; the tier columns come from
    a join on the customer key. Amounts are summed in DECIMAL; the share is a
    DOUBLE of the two exact sums."""
    bad = violations.groupBy(F.col("tx_id").alias("_vtx")).agg(F.lit(True).alias("_bad"))
    tx = transactions.select(tx_key, customer_key, F.col(amount).cast("decimal(12,2)").alias("_amt"))
    tx = tx.join(bad, tx[tx_key] == bad["_vtx"], "left").drop("_vtx")
    cust = customers.select(customer_key, *tier_cols)
    joined = tx.join(cust, customer_key)
    return exposure_by(joined, tier_cols)


def exposure_by(df: DataFrame, tier_cols: Sequence[str], amount: str = "_amt", flag: str = "_bad") -> DataFrame:
    """Aggregate step of C9 over a frame that already carries the tier, the
    DECIMAL amount and a violation flag."""
    bad = F.coalesce(F.col(flag), F.lit(False))
    out = df.groupBy(*tier_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_tx"),
        F.count(F.when(bad, 1)).cast("bigint").alias("n_violating"),
        F.sum(amount).cast("decimal(22,2)").alias("total_amount"),
        F.coalesce(F.sum(F.when(bad, F.col(amount))), F.lit(0)).cast("decimal(22,2)").alias(
            "violating_amount"
        ),
    )
    return out.withColumn(
        "violating_share",
        F.try_divide(F.col("violating_amount").cast("double"), F.col("total_amount").cast("double")),
    )


def payload_fields(
    df: DataFrame,
    fields: dict[str, str],
    payload: str = "payload",
    keep: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Typed fields out of a JSON text column plus ``payload_valid``.
    ``fields`` maps output name → ``"$.path:type"``; the reference names no
    keys, so they are always a parameter."""
    extracted = extract_json_fields(payload, fields)
    valid = json_is_valid(payload)
    return df.select(*keep, *[c.alias(n) for n, c in extracted.items()], valid.alias("payload_valid"))
