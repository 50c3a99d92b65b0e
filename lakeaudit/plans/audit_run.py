"""One audit run over the five compliance tables (C1–C9 together).

The reference schedules a "Data Quality Checks" job over its audit tables and
declares the ``violations`` table it would fill. Here one call runs every
check on the contracts' tables and writes each finding set to the shared
staging folder (or a caller's folder):

1. violation findings (C1 + C5: fee, FX, receive amount, stated-value drift,
   with corridor and overflow flags) — written first; the contract-shaped
   ``violations`` table, the summary and the exposure are computed from the
   written files, so the reconciliation is not recomputed for each of them and
   its lineage is cut at a durable copy;
2. late / overdue deliveries (C2), transactions without a disclosure (C3),
   receipt problems (C4), audit-trail summaries (C6), payload fields (C7, when
   keys are given), and the contracts' quality report (G7: NOT NULL, keys,
   foreign keys between the five tables);
3. violation rollup (C8) and customer risk exposure (C9).

Every output is an ordinary Spark job; the driver receives only the report of
row counts. Rerunning with the same inputs and parameters rewrites the same
rows (``detected_at`` and ``as_of`` are parameters, never the clock).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeaudit.contracts import AUDIT_EVENTS, CUSTOMERS, DISCLOSURES, TRANSACTIONS, VIOLATIONS, conform
from lakeaudit.operators import deadlines, quality, reconcile, summaries, trails
from lakeaudit.session import staging_path


@dataclass
class AuditParams:
    detected_at: str = "2025-01-01 00:00:00"
    as_of: str | None = None
    fee_tolerance: float = 0.0
    fx_tolerance: float = 0.0
    amount_tolerance: float = 0.0
    grace_seconds: int = 0
    receipt_limit_seconds: int = 86400
    trail_block_width: int | None = None
    payload_fields: dict[str, str] = field(default_factory=dict)
    summary_dims: tuple[str, ...] = ("severity", "rule_id", "corridor")
    tier_cols: tuple[str, ...] = ("kyc_tier", "risk_level")


REPORT_SCHEMA = "output string, path string, rows bigint"


def _write(df: DataFrame, path: str, name: str) -> int:
    obs = Observation(f"audit:{name}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return int(obs.get["rows"])


def run_audit(
    spark: SparkSession,
    customers: DataFrame,
    transactions: DataFrame,
    disclosures: DataFrame,
    audit_events: DataFrame,
    params: AuditParams | None = None,
    out_root: str | None = None,
) -> DataFrame:
    """Run every audit check and write the results under ``out_root``.
    Returns ``(output, path, rows)`` per written result."""
    p = params or AuditParams()
    out_root = (out_root or staging_path(spark, "audit-run")).rstrip("/")
    report = []

    def put(name: str, df: DataFrame) -> str:
        path = f"{out_root}/{name}"
        report.append((name, path, _write(df, path, name)))
        return path

    rules = reconcile.transaction_rules(p.fee_tolerance, p.fx_tolerance, p.amount_tolerance)
    findings_path = put(
        "violation_findings",
        reconcile.reconcile_transactions(transactions, disclosures, p.detected_at, rules),
    )
    # The violations table exactly as the contract declares it, from the
    # written findings (no second reconciliation).
    put("violations", conform(spark.read.parquet(findings_path), VIOLATIONS))
    put(
        "late_deliveries",
        deadlines.late_or_undelivered(
            transactions, grace_seconds=p.grace_seconds, as_of=p.as_of,
            keep=("tx_id", "customer_id", "corridor"),
        ),
    )
    put("missing_disclosures", reconcile.missing_counterpart(transactions, disclosures, "tx_id", "tx_id"))
    put("receipt_checks", deadlines.receipt_checks(disclosures, receipt_limit_seconds=p.receipt_limit_seconds))
    put("trail_summary", trails.trail_summary(audit_events, tie=("event_id",), block_width=p.trail_block_width))
    if p.payload_fields:
        put("payload_fields", summaries.payload_fields(audit_events, p.payload_fields, keep=("event_id", "tx_id")))

    parents = {"customers": customers, "transactions": transactions}
    checks = [
        quality.contract_checks(df, contract, parents=parents)
        for df, contract in ((customers, CUSTOMERS), (transactions, TRANSACTIONS),
                             (disclosures, DISCLOSURES), (audit_events, AUDIT_EVENTS))
    ]
    put("quality_report", quality.union_reports(checks))

    violations = spark.read.parquet(findings_path)
    put("violation_rollup", summaries.violation_summary(violations, p.summary_dims, "rollup"))
    put("risk_exposure", summaries.risk_exposure(customers, transactions, violations, p.tier_cols))
    return spark.createDataFrame(report, REPORT_SCHEMA)
