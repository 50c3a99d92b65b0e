"""Contract gate: split a load into good and quarantined rows with reasons (S3).

The reference only prints "COPY INTO failed" and leaves the table possibly
empty. Here every row gets an array of reason codes in one pass:

* ``parse_error`` — the reader put the raw line in ``_corrupt_record``
  (bad timestamp, decimal overflow, text in a number column);
* ``null:<col>`` — a NOT NULL column of the contract is NULL;
* ``absent:<col>`` — the input has no such column, though the contract says NOT NULL;
* ``domain:<col>`` — a value outside the column's declared domain.

A row is good iff the array is empty. Good + quarantined = read, always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.contracts import Contract

CORRUPT = "_corrupt_record"


def reasons(contract: Contract, columns: list[str], corrupt: str | None = CORRUPT) -> Column:
    """Array of reason codes for one row (empty when the row passes)."""
    checks = []
    if corrupt and corrupt in columns:
        checks.append(F.when(F.col(corrupt).isNotNull(), F.lit("parse_error")))
    for name in contract.not_null:
        checks.append(F.when(F.col(name).isNull(), F.lit(f"null:{name}")) if name in columns else F.lit(f"absent:{name}"))
    for name, values in contract.domains.items():
        if name in columns:
            bad = F.col(name).isNotNull() & ~F.col(name).isin(list(values))
            checks.append(F.when(bad, F.lit(f"domain:{name}")))
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def tag(df: DataFrame, contract: Contract, corrupt: str | None = CORRUPT) -> DataFrame:
    """Add ``reasons`` (array<string>) and ``is_rejected``."""
    r = reasons(contract, df.columns, corrupt)
    return df.withColumn("reasons", r).withColumn("is_rejected", F.size("reasons") > 0)


def split(tagged: DataFrame, corrupt: str | None = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantined)`` from a tagged frame. Good rows keep only the
    contract columns; quarantined rows keep everything plus their reasons.
    To produce both from one scan, write ``tagged`` once partitioned by
    ``is_rejected`` (see ``plans.loads.gated_load``)."""
    drop = ["reasons", "is_rejected"] + ([corrupt] if corrupt and corrupt in tagged.columns else [])
    good = tagged.filter(~F.col("is_rejected")).drop(*drop)
    bad = tagged.filter(F.col("is_rejected")).drop("is_rejected")
    return good, bad


def reason_rows(tagged: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: one row per (rejected row, reason)."""
    return tagged.filter(F.col("is_rejected")).select(*keep, F.explode("reasons").alias("reason"))
