"""Money arithmetic in DECIMAL.

Summing doubles depends on the order rows arrive in, so totals would differ
between runs and engines. Amounts are cast to DECIMAL before any sum and the
result is cast once, at the end, to an explicit width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeaudit.functions._util import col_of


def money(c, precision: int = 12, scale: int = 2) -> Column:
    """Cast an amount to DECIMAL(precision, scale); rounds half up."""
    return col_of(c).cast(f"decimal({precision},{scale})")


def rate(c) -> Column:
    """Cast a discount or tax rate to DECIMAL(9, 6), so it is not rounded to cents."""
    return col_of(c).cast("decimal(9,6)")


def money_sum(c, precision: int = 22, scale: int = 2) -> Column:
    """Exact sum of a DECIMAL expression, cast to a fixed result width."""
    return F.sum(col_of(c)).cast(f"decimal({precision},{scale})")


def pct_change(delta, base, precision: int = 8, scale: int = 4) -> Column:
    """``delta / base * 100`` as DECIMAL(precision, scale).

    A zero base gives NULL (``try_divide``); a result too wide for the target
    type gives NULL too (``try_cast``) instead of failing the job under ANSI.
    """
    # Operands are narrowed to DECIMAL(20,6) first so Spark keeps 18 digits of
    # scale in the quotient; the final cast then rounds (half up) from an
    # effectively exact value instead of rounding twice.
    num = (col_of(delta) * F.lit(100)).try_cast("decimal(20,6)")
    den = col_of(base).try_cast("decimal(20,6)")
    return F.try_divide(num, den).try_cast(f"decimal({precision},{scale})")
