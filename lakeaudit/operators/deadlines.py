"""Deadline checks (C2, C4): pure column predicates, no shuffle.

The reference declares the timestamps (promised/actual delivery, disclosed_at,
receipt_sent_at, cancellation_deadline) and which are nullable; the limits are
parameters of ours. ``as_of`` is a parameter, never the clock, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.time import seconds_between


def late_or_undelivered(
    df: DataFrame,
    promised: str = "promised_delivery_ts",
    actual: str = "actual_delivery_ts",
    grace_seconds: int = 0,
    as_of: str | None = None,
    keep: Sequence[str] = ("tx_id",),
) -> DataFrame:
    """C2. ``late`` iff actual > promised + grace; ``overdue`` iff actual is
    NULL and promised + grace < as_of. On-time rows are dropped. Returns
    ``keep`` columns, both timestamps, ``status`` and ``delay_seconds``
    (actual − promised; for overdue rows, as_of − promised)."""
    p = F.col(promised)
    a = F.col(actual)
    deadline = p + F.make_dt_interval(secs=F.lit(grace_seconds))
    late = a.isNotNull() & (a > deadline)
    if as_of is not None:
        as_of_ts = F.lit(as_of).cast(df.schema[promised].dataType)
        overdue = a.isNull() & (deadline < as_of_ts)
        delay_to = F.when(a.isNull(), as_of_ts).otherwise(a)
    else:
        overdue = F.lit(False)
        delay_to = a
    status = F.when(late, F.lit("late")).when(overdue, F.lit("overdue"))
    return (
        df.select(*keep, promised, actual, status.alias("status"),
                  seconds_between(p, delay_to).cast("bigint").alias("delay_seconds"))
        .filter(F.col("status").isNotNull())
    )


def receipt_checks(
    df: DataFrame,
    disclosed_at: str = "disclosed_at",
    receipt_sent_at: str = "receipt_sent_at",
    cancellation_deadline: str = "cancellation_deadline",
    receipt_limit_seconds: int = 86400,
    keep: Sequence[str] = ("tx_id", "disclosure_id"),
) -> DataFrame:
    """C4, one row per failed check: ``receipt_missing`` (receipt time NULL),
    ``receipt_late`` (sent after disclosed_at + limit), ``deadline_invalid``
    (cancellation deadline before disclosure). All checks in one pass."""
    d = F.col(disclosed_at)
    r = F.col(receipt_sent_at)
    c = F.col(cancellation_deadline)
    limit = d + F.make_dt_interval(secs=F.lit(receipt_limit_seconds))
    checks = F.array(
        F.when(r.isNull(), F.lit("receipt_missing")),
        F.when(r.isNotNull() & (r > limit), F.lit("receipt_late")),
        F.when(c < d, F.lit("deadline_invalid")),
    )
    failed = F.filter(checks, lambda x: x.isNotNull())
    return df.select(
        *keep, disclosed_at, receipt_sent_at, cancellation_deadline,
        F.explode(failed).alias("check_name"),
    )
