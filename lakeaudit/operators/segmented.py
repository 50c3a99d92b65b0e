"""Per-key ordered operations that survive a hot key.

A window ``partitionBy(key)`` sends every row of a key to one task; if one key
holds a third of the data, that task holds a third of the data. The helpers
here split each key into *blocks* — a caller-supplied column that never
decreases along the order (``floor(seq / 65536)``, the hour of a timestamp) —
and compute the ordered result per (key, block):

1. a small per-block table (one row per key and block) is built with a partial
   aggregation, so the hot key is combined map-side before the shuffle;
2. a window over that small table, partitioned by key and ordered by block,
   gives each block the state carried in from earlier blocks (a row offset,
   a running sum, the last row);
3. rows are joined to their block's carry on (key, block) and finished with a
   window partitioned by (key, block). The join and that window share one hash
   partitioning, so the last step adds no shuffle, and a hot key is spread over
   as many tasks as it has blocks.

Splitting costs a second pass over the rows, so it is paid only when needed:
``range_blocks`` measures the busiest key with one small aggregate and gives no
block when every key fits in one; the helpers then run a plain per-key window,
with the same result. ``block_width_for`` gives a fixed width instead, for
orders known to be spread evenly.

"Keep the latest row per key" needs no window at all: ``max(struct(order...,
rest...))`` is an ordinary aggregate with map-side combining.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeaudit.functions._util import col_of
from lakeaudit.session import staging_path

_BLK = "_la_block"


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def latest_per_key(df: DataFrame, keys, order: Sequence[str], earliest: bool = False) -> DataFrame:
    """One row per key: the row with the greatest ``order`` tuple (or least with
    ``earliest``). The remaining columns break ties, so the pick is total and
    repeatable even when ``order`` has ties; fully equal rows are interchangeable.
    """
    keys = _names(keys)
    order = _names(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("_la_row")
    pick = F.min(packed) if earliest else F.max(packed)
    out = df.groupBy(*keys).agg(pick.alias("_la_row"))
    return out.select(*keys, *[F.col(f"_la_row.{c}").alias(c) for c in order + rest]).select(
        *df.columns
    )


def seq_block(seq, width: int = 1 << 16) -> Column:
    """Block of an integer sequence: ``floor(seq / width)``."""
    return F.floor(col_of(seq) / F.lit(width)).cast("bigint")


def time_block(ts, width_seconds: int = 3600) -> Column:
    """Block of a timestamp (or TIMESTAMP_NTZ): ``floor(epoch_seconds / width)``."""
    return F.floor(F.unix_timestamp(col_of(ts)) / F.lit(width_seconds)).cast("bigint")


def _as_number(c: Column, dtype) -> Column:
    from pyspark.sql import types as T

    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(c)
    return c


def block_width_for(df: DataFrame, keys, order_col: str, rows_per_block: int = 1 << 20) -> int | None:
    """A block width for ``order_col`` sized to the data, or ``None`` when no
    key holds more than ``rows_per_block`` rows (then a plain per-key window is
    cheapest and nothing needs splitting).

    With the busiest key holding ``n`` rows spread over a value range of
    ``span``, a width of ``span · rows_per_block / n`` gives that key about
    ``rows_per_block`` rows per block (timestamps are measured in seconds).
    Blocks therefore get narrower as the hot key grows. One small aggregate job
    (per-key counts, then the maximum and the value range) runs when this is
    called.
    """
    from pyspark.sql import types as T

    keys = _names(keys)
    dtype = df.schema[order_col].dataType
    if not isinstance(dtype, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return None  # no numeric span to cut (e.g. text): callers fall back to a plain window
    x = _as_number(F.col(order_col), dtype)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    stats = per_key.agg(F.max("_n").alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).first()
    if stats is None or stats["n"] is None or stats["lo"] is None or stats["n"] <= rows_per_block:
        return None
    span = float(stats["hi"] - stats["lo"]) + 1.0
    return max(1, int(-(-span * rows_per_block // stats["n"])))


def range_blocks(df: DataFrame, keys, order, rows_per_block: int = 1 << 20) -> tuple[DataFrame, Column | None]:
    """``df`` with a block column, for keys too busy for one window; no block when none is.

    Rows are range-partitioned by (keys, order) into parts of about ``rows_per_block`` rows
    and written to the shared folder with the number of their part. The bounds come from the
    rows themselves, so a key whose rows crowd into a small part of its range is split as
    evenly as any other, whatever the type of the order columns. Rows equal in all keys and
    order columns share a block. The written numbers do not change when a task is repeated.
    """
    keys, order = _names(keys), _names(order)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    busiest, total = per_key.agg(F.max("_n"), F.sum("_n")).first()
    if busiest is None or busiest <= rows_per_block:
        return df, None
    spark = df.sparkSession
    path = staging_path(spark, "blocks")
    parts = -(-total // rows_per_block)
    df.repartitionByRange(parts, *keys, *order).withColumn(_BLK, F.spark_partition_id()).write.parquet(path)
    blocked = spark.read.parquet(path)
    return blocked, F.col(_BLK)


def _order_cols(order) -> list[Column]:
    return [col_of(c) for c in _names(order)]


def ordered_blocked(
    df: DataFrame,
    keys,
    order,
    block: Column | None,
    row_number: str | None = None,
    running: dict[str, Column] | None = None,
    lag_cols: Sequence[str] = (),
    lag_prefix: str = "prev_",
) -> DataFrame:
    """One block-split pass computing, per key along ``order``, any of:

    * ``row_number`` — 1, 2, … (``order`` must be total within a key);
    * ``running`` — ``{out: value}`` running sums, rows frame, current row
      included;
    * ``lag_cols`` — the previous row's values (NULL on a key's first row).

    Cost: one partial aggregate per (key, block), one window over that small
    table, one join on (key, block) and one window partitioned by (key, block)
    sharing the join's partitioning — whatever mix of outputs is requested.
    With ``block=None`` (no key is large enough to need splitting, see
    ``block_width_for``) the same outputs come from one plain per-key window.
    """
    keys = _names(keys)
    order_names = _names(order)
    running = dict(running or {})
    lag_cols = list(lag_cols)
    if block is None:
        return _ordered_plain(df, keys, order_names, row_number, running, lag_cols, lag_prefix)
    tagged = df.withColumn(_BLK, block)
    for i, (name, value) in enumerate(running.items()):
        tagged = tagged.withColumn(f"_la_v{i}", value)
    aggs = []
    if row_number:
        aggs.append(F.count(F.lit(1)).alias("_la_n"))
    for i in range(len(running)):
        aggs.append(F.sum(f"_la_v{i}").alias(f"_la_s{i}"))
    carried = list(dict.fromkeys(order_names + lag_cols))
    packed = F.struct(*[F.col(c) for c in carried])
    if lag_cols:
        aggs.append(F.max(packed).alias("_la_last"))
    per_block = tagged.groupBy(*keys, _BLK).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    if row_number:
        carry_cols.append(F.coalesce(F.sum("_la_n").over(before), F.lit(0)).alias("_la_off"))
    for i in range(len(running)):
        carry_cols.append(F.sum(f"_la_s{i}").over(before).alias(f"_la_c{i}"))
    if lag_cols:
        carry_cols.append(F.lag("_la_last").over(Window.partitionBy(*keys).orderBy(_BLK)).alias("_la_carry"))
    carry = per_block.select(*keys, _BLK, *carry_cols)

    ordered = Window.partitionBy(*keys, _BLK).orderBy(*_order_cols(order_names))
    frame = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Null-safe: rows with a NULL key or a NULL order value (whose block is NULL,
    # the first one) are rows of their key like any other.
    at = [*keys, _BLK]
    carry = carry.select(*[F.col(c).alias(f"_la_at{i}") for i, c in enumerate(at)], *[c for c in carry.columns if c not in at])
    met = F.lit(True)
    for i, c in enumerate(at):
        met = met & F.col(c).eqNullSafe(F.col(f"_la_at{i}"))
    joined = tagged.join(carry, met)
    outs = []
    if row_number:
        outs.append((F.col("_la_off") + F.row_number().over(ordered)).cast("bigint").alias(row_number))
    for i, name in enumerate(running):
        run = F.sum(f"_la_v{i}").over(frame)
        outs.append(
            F.when(F.col(f"_la_c{i}").isNull(), run).otherwise(F.col(f"_la_c{i}") + run).alias(name)
        )
    if lag_cols:
        outs.append(F.coalesce(F.lag(packed).over(ordered), F.col("_la_carry")).alias("_la_prev"))
    out = joined.select(*[c for c in df.columns if c != _BLK], *outs)
    if lag_cols:
        out = out.select(
            *[c for c in out.columns if c != "_la_prev"],
            *[F.col(f"_la_prev.{c}").alias(lag_prefix + c) for c in lag_cols],
        )
    return out


def _ordered_plain(df, keys, order_names, row_number, running, lag_cols, lag_prefix) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(*_order_cols(order_names))
    frame = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outs = []
    if row_number:
        outs.append(F.row_number().over(ordered).cast("bigint").alias(row_number))
    for name, value in running.items():
        outs.append(F.sum(value).over(frame).alias(name))
    for c in lag_cols:
        outs.append(F.lag(c).over(ordered).alias(lag_prefix + c))
    return df.select(*df.columns, *outs)


def row_number_blocked(
    df: DataFrame, keys, order, block: Column | None, out: str = "rn"
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` computed per
    (key, block). ``order`` must be total within a key for a repeatable answer."""
    return ordered_blocked(df, keys, order, block, row_number=out)


def running_sum_blocked(
    df: DataFrame, keys, order, value, block: Column | None, out: str = "running"
) -> DataFrame:
    """Running ``sum(value)`` per key along ``order`` (rows frame, current row
    included), computed per (key, block). Use a DECIMAL value for exact money."""
    return ordered_blocked(df, keys, order, block, running={out: col_of(value)})


def lag_blocked(
    df: DataFrame, keys, order, cols, block: Column | None, prefix: str = "prev_"
) -> DataFrame:
    """Previous row's ``cols`` per key along ``order`` (NULL on a key's first
    row), computed per (key, block). The first row of a block takes the last
    row of the key's previous non-empty block."""
    return ordered_blocked(df, keys, order, block, lag_cols=_names(cols), lag_prefix=prefix)
