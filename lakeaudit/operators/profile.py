"""Column profile (M5): the statistics behind ``describe_table``.

One aggregate computes, for every column at once, the non-NULL count, the NULL
count and min/max; ``inline`` over an array of structs unpivots the single wide
row to one row per column; exact distinct counts are a second aggregate. Min and max are rendered as text so columns of
different types fit one result column (floating point through DECIMAL(38,6) so
the text has no exponent).

``exact=False`` uses ``approx_count_distinct`` (HyperLogLog++, mergeable
partials, no shuffle of values): the right choice for wide tables at scale.
Exact distinct counts re-shuffle every column's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_text(c, dtype):
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.try_cast("decimal(38,6)").cast("string")
    return c.cast("string")


def _identity(c, dtype):
    """What stands for a value in an exact distinct count: texts and bytes by 128 bits of two hashes, so that no
    long value is shuffled. Two of n different values share them with a probability of about n² / 2^129
    (3e-19 for ten billion values)."""
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        return c
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c), F.xxhash64(F.lit(7), c)))


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True, rsd: float = 0.05) -> DataFrame:
    """Long profile ``(column_name, ordinal, data_type, row_count, null_count,
    distinct_count, min_value, max_value)``.

    Plain statistics (counts, min, max) come from one global aggregate, which
    needs no sort even for text min/max. Exact distinct counts are a separate
    aggregate: Spark expands each row once per column and counts distinct
    (column, value) pairs with hash aggregation, texts by 128-bit hashes. Mixing both in one aggregate
    would force a sort-based plan over the expanded rows. The two results have
    one row per column and are joined on the ordinal. With ``exact=False`` the
    distinct count is HyperLogLog++ inside the single aggregate.
    """
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        col = F.col(c)
        aggs += [
            F.count(col).alias(f"_nn{i}"),
            _as_text(F.min(col), types[c]).alias(f"_mn{i}"),
            _as_text(F.max(col), types[c]).alias(f"_mx{i}"),
        ]
        if not exact:
            aggs.append(F.approx_count_distinct(col, rsd).alias(f"_nd{i}"))
    wide = df.agg(*aggs)
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i + 1).cast("int").alias("ordinal"),
            F.lit(types[c].simpleString()).alias("data_type"),
            F.col("_rows").cast("bigint").alias("row_count"),
            (F.col("_rows") - F.col(f"_nn{i}")).cast("bigint").alias("null_count"),
            (F.lit(None) if exact else F.col(f"_nd{i}")).cast("bigint").alias("distinct_count"),
            F.col(f"_mn{i}").alias("min_value"),
            F.col(f"_mx{i}").alias("max_value"),
        )
        for i, c in enumerate(columns)
    ]
    stats = wide.select(F.inline(F.array(*entries)))
    if not exact:
        return stats
    distinct = df.agg(*[F.count_distinct(_identity(F.col(c), types[c])).alias(f"_nd{i}") for i, c in enumerate(columns)])
    counts = distinct.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).cast("int").alias("ordinal"), F.col(f"_nd{i}").cast("bigint").alias("_nd"))
        for i in range(len(columns))
    ])))
    out = stats.join(F.broadcast(counts), "ordinal")
    return out.select(
        "column_name", "ordinal", "data_type", "row_count", "null_count",
        F.col("_nd").alias("distinct_count"), "min_value", "max_value",
    )
