"""Stated-versus-actual reconciliation (C1, C5) and missing counterparts.

The reference declares the ``violations`` table (disclosed_value, actual_value,
delta DECIMAL(12,6), delta_pct DECIMAL(8,4), severity, rule_id, description,
detected_at) but not the rules that fill it. Rule ids, tolerances and severity
bands here are parameters of ours.

All rules are evaluated in one pass: each input row builds an array with one
struct per rule, ``explode`` turns it into long form, and a filter keeps the
violations. No rule rescans the input and no union of per-rule plans is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions._util import col_of
from lakeaudit.functions.money import pct_change
from lakeaudit.operators.segmented import latest_per_key


@dataclass(frozen=True)
class Rule:
    """One stated-vs-actual comparison.

    ``stated``/``actual`` are column names or expressions over the input row.
    A row violates the rule when ``|actual − stated| > tolerance`` (or when
    exactly one of the two is NULL). Severity comes from ``bands``: the first
    ``(pct, name)`` with ``|delta_pct| ≥ pct`` wins, else ``default_severity``;
    a NULL percent (stated 0 or overflow) counts as the first band.
    """

    rule_id: str
    stated: object
    actual: object
    tolerance: float = 0.0
    description: str = ""
    bands: tuple[tuple[float, str], ...] = ((10.0, "high"), (1.0, "medium"))
    default_severity: str = "low"


# Common element type of the per-rule structs.
_WIDE = "decimal(38,6)"


def _rule_values(i: int, rule: Rule) -> list[Column]:
    """Per-rule intermediate columns, computed once in a projection so the
    quotient and differences are not re-evaluated inside the struct array."""
    stated = col_of(rule.stated)
    actual = col_of(rule.actual)
    return [stated.alias(f"_s{i}"), actual.alias(f"_a{i}")]


def _rule_derived(i: int) -> list[Column]:
    stated, actual = F.col(f"_s{i}"), F.col(f"_a{i}")
    delta = actual - stated
    return [delta.alias(f"_d{i}"), pct_change(delta, stated).alias(f"_p{i}")]


def _rule_struct(i: int, rule: Rule) -> Column:
    stated, actual = F.col(f"_s{i}"), F.col(f"_a{i}")
    delta, pct = F.col(f"_d{i}"), F.col(f"_p{i}")
    abs_pct = F.abs(pct)
    severity = F.lit(rule.default_severity)
    for threshold, name in reversed(rule.bands):
        severity = F.when(abs_pct >= F.lit(threshold), F.lit(name)).otherwise(severity)
    if rule.bands:
        severity = F.when(pct.isNull(), F.lit(rule.bands[0][1])).otherwise(severity)
    violated = (F.abs(delta) > F.lit(rule.tolerance)) | (
        stated.isNull() != actual.isNull()
    )
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        stated.cast("string").alias("disclosed_value"),
        actual.cast("string").alias("actual_value"),
        delta.try_cast("decimal(12,6)").alias("delta"),
        delta.cast(_WIDE).alias("delta_full"),
        pct.alias("delta_pct"),
        severity.alias("severity"),
        F.lit(rule.description or rule.rule_id).alias("description"),
        F.coalesce(violated, F.lit(False)).alias("violated"),
        (pct.isNull() & stated.isNotNull() & actual.isNotNull() & (stated != F.lit(0))).alias("pct_overflow"),
    )


def reconcile(
    df: DataFrame,
    tx_id,
    rules: Sequence[Rule],
    detected_at: str = "2025-01-01 00:00:00",
    only_violations: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Evaluate ``rules`` on each row of ``df`` in one pass.

    Returns rows in the violations contract's column order, plus
    ``delta_overflow`` (delta did not fit DECIMAL(12,6)), ``pct_overflow``
    (the percent did not fit DECIMAL(8,4); a zero base is not an overflow),
    ``violated``, and any
    ``keep`` columns (for grouping later, e.g. a corridor). ``detected_at`` is
    a parameter, not the clock, so reruns agree; ``violation_id`` is the MD5 of
    ``tx_id:rule_id`` for the same reason. ``detected_at`` is a wall-clock
    TIMESTAMP_NTZ, like every timestamp of the driver's data.
    """
    tx = col_of(tx_id).cast("string")
    base = df.select(
        tx.alias("tx_id"), *keep, *[c for i, r in enumerate(rules) for c in _rule_values(i, r)]
    )
    derived = base.select(
        "*", *[c for i in range(len(rules)) for c in _rule_derived(i)]
    )
    checks = F.array(*[_rule_struct(i, r) for i, r in enumerate(rules)])
    long = derived.select("tx_id", *keep, F.explode(checks).alias("_r"))
    if only_violations:
        long = long.filter(F.col("_r.violated"))
    return long.select(
        F.md5(F.concat_ws(":", "tx_id", "_r.rule_id")).alias("violation_id"),
        "tx_id",
        F.col("_r.rule_id").alias("rule_id"),
        F.col("_r.severity").alias("severity"),
        F.col("_r.disclosed_value").alias("disclosed_value"),
        F.col("_r.actual_value").alias("actual_value"),
        F.col("_r.delta").alias("delta"),
        F.col("_r.delta_pct").alias("delta_pct"),
        F.col("_r.description").alias("description"),
        F.lit(detected_at).cast("timestamp_ntz").alias("detected_at"),
        (F.col("_r.delta").isNull() & F.col("_r.delta_full").isNotNull()).alias(
            "delta_overflow"
        ),
        F.col("_r.pct_overflow").alias("pct_overflow"),
        F.col("_r.violated").alias("violated"),
        *keep,
    )


def latest_disclosure(
    disclosures: DataFrame,
    tx_id: str = "tx_id",
    order: Sequence[str] = ("disclosed_at", "disclosure_id"),
) -> DataFrame:
    """One disclosure per transaction: the latest by ``order``."""
    return latest_per_key(disclosures, tx_id, list(order))


# Fixed rule set for the audit contracts (ours; the reference lists none).
def transaction_rules(fee_tol: float = 0.0, fx_tol: float = 0.0, amount_tol: float = 0.0):
    """Rules over ``transactions ⋈ latest disclosure``: fee, FX rate, receive
    amount (C1), and drift between the stated values both tables carry (C5)."""
    return [
        Rule("FEE_MISMATCH", "d_disclosed_fee", "charged_fee", fee_tol,
             "charged fee differs from disclosed fee"),
        Rule("FX_RATE_MISMATCH", "d_disclosed_fx_rate", "applied_fx_rate", fx_tol,
             "applied FX rate differs from disclosed rate"),
        Rule("RECEIVE_AMOUNT_MISMATCH", "disclosed_receive_amount", "receive_amount",
             amount_tol, "received amount differs from disclosed amount"),
        Rule("STATED_FEE_DRIFT", "d_disclosed_fee", "disclosed_fee", 0.0,
             "fee stated on the transaction differs from the disclosure"),
        Rule("STATED_FX_DRIFT", "d_disclosed_fx_rate", "disclosed_fx_rate", 0.0,
             "FX rate stated on the transaction differs from the disclosure"),
    ]


def reconcile_transactions(
    transactions: DataFrame,
    disclosures: DataFrame,
    detected_at: str = "2025-01-01 00:00:00",
    rules: Sequence[Rule] | None = None,
    only_violations: bool = True,
) -> DataFrame:
    """C1 + C5 on the audit contracts: transactions inner-joined to their latest
    disclosure (transactions without one are C3's business), then all rules in
    one exploded pass. The join is 1:1 on tx_id after the disclosure dedupe."""
    d = latest_disclosure(disclosures).select(
        "tx_id",
        F.col("disclosed_fee").alias("d_disclosed_fee"),
        F.col("disclosed_fx_rate").alias("d_disclosed_fx_rate"),
        "disclosed_receive_amount",
    )
    joined = transactions.join(d, "tx_id")
    return reconcile(
        joined, "tx_id", rules or transaction_rules(), detected_at, only_violations,
        keep=["corridor"],
    )


# --------------------------------------------------------------------------- C3
def missing_counterpart(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with no row in ``right`` on the key (a left anti join):
    transactions without a disclosure, orders without lines, lines without an
    order. Only the right key column is read from ``right``."""
    r = right.select(F.col(right_key).alias("_rk"))
    return left.join(r, left[left_key] == r["_rk"], "left_anti")
