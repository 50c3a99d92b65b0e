"""Data quality checks (G7): NOT NULL, domain, key uniqueness, foreign keys.

The reference schedules a "Data Quality Checks" job and declares the
constraints (NOT NULL flags, a primary key, a foreign key, two domains); the
checks are ours. The report is long form:
``(table_name, check_name, column_name, failed_rows, total_rows)``.

Cost: NOT NULL and domain checks of a table share one aggregate (one scan, no
shuffle beyond the single-row partials). A key check is one aggregate on the
key (map-side combined). A foreign-key check aggregates the parent keys to
distinct values and left-joins the child's key column to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.contracts import Contract


def _report_row(table: str, check: str, column: str, failed, total):
    return (
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check_name"),
        F.lit(column).alias("column_name"),
        failed.cast("bigint").alias("failed_rows"),
        total.cast("bigint").alias("total_rows"),
    )


def column_checks(
    df: DataFrame,
    table: str,
    not_null: Sequence[str] = (),
    domains: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """NOT NULL and domain checks in one aggregate, unpivoted to long form."""
    domains = domains or {}
    aggs = [F.count(F.lit(1)).alias("_total")]
    names = []
    for i, c in enumerate(not_null):
        aggs.append(F.count(F.when(F.col(c).isNull(), 1)).alias(f"_f{i}"))
        names.append(("not_null", c, f"_f{i}"))
    for j, (c, values) in enumerate(domains.items()):
        bad = F.col(c).isNotNull() & ~F.col(c).isin(list(values))
        aggs.append(F.count(F.when(bad, 1)).alias(f"_d{j}"))
        names.append(("domain", c, f"_d{j}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(*_report_row(table, check, col, F.col(alias), F.col("_total")))
        for check, col, alias in names
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def key_check(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Duplicate keys: ``failed_rows`` = number of key values held by more than
    one row (NULL keys included as a value)."""
    key = list(key)
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        *_report_row(table, "unique_key", ",".join(key),
                     F.count(F.when(F.col("_n") > 1, 1)), F.coalesce(F.sum("_n"), F.lit(0)))
    )


def foreign_key_check(
    child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Child rows whose non-NULL key has no parent row. The child is combined to
    one counted row per key before the join, so a hot key is one row of it."""
    parents = parent.groupBy(F.col(parent_column).alias("_pk")).agg(F.lit(True).alias("_hit"))
    c = child.groupBy(F.col(column).alias("_ck")).agg(F.count(F.lit(1)).alias("_n"))
    joined = c.join(parents, c["_ck"] == parents["_pk"], "left")
    orphan = F.col("_ck").isNotNull() & F.col("_hit").isNull()
    none = F.lit(0)
    return joined.agg(
        *_report_row(
            table, "foreign_key", column,
            F.coalesce(F.sum(F.when(orphan, F.col("_n"))), none), F.coalesce(F.sum("_n"), none),
        )
    )


def contract_checks(
    df: DataFrame,
    contract: Contract,
    table: str | None = None,
    parents: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """All checks a contract declares: NOT NULL, domains, key, and each
    foreign key whose parent table is given in ``parents`` (name → frame)."""
    table = table or contract.name
    parts = [column_checks(df, table, contract.not_null, contract.domains)]
    if contract.key:
        parts.append(key_check(df, table, contract.key))
    for fk in contract.foreign_keys:
        if parents and fk.ref_table in parents:
            parts.append(foreign_key_check(df, table, fk.column, parents[fk.ref_table], fk.ref_column))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_reports(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
