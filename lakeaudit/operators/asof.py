"""As-of join: each row with the value that was valid at its time.

``asof_join`` gives every left row the last right row of its key whose time is not later
(``backward``), or the first whose time is not earlier (``forward``): the rate, quote or
disclosure in force when a transaction was made.

Both sides are merged into one ordered stream per key, and a left row takes the last right
row before it. A key too busy for one window is split: ``range_blocks`` range-partitions
the merged rows by (key, time) into blocks of about ``rows_per_block`` rows, each block
fills its own rows, and the last right row of earlier blocks is carried in from a
window over one row per key and block. So no task holds more than a block of a key,
however its rows are spread over time or between the sides, and no pair of rows is ever
formed: the cost is a sort of both sides, not a range join.

Defined cases: equal times match unless ``allow_exact`` is false; of several right rows at
one time the greatest by their remaining columns is taken (with ``forward``, the least); rows of
the right with a null key or time are ignored; left rows with a null key or time keep null
values; with ``tolerance`` a value further away in time than that is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.operators.segmented import _BLK, range_blocks

ROWS_PER_BLOCK = 1 << 20


def _distance(late: Column, early: Column, dtype: T.DataType) -> Column:
    """``late - early``: in seconds for dates and timestamps, in units of the column for numbers."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(1_000_000)
    if isinstance(dtype, T.DateType):
        return F.datediff(late, early) * F.lit(86_400)
    return late - early


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    tolerance: float | None = None,
    direction: str = "backward",
    allow_exact: bool = True,
    prefix: str = "",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """All rows and columns of ``left`` with ``prefix`` + each of ``values`` (columns of ``right``).

    ``keys`` name columns of both sides; ``tolerance`` is in seconds for dates and timestamps.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction!r}")
    clash = [prefix + v for v in values if prefix + v in left.columns]
    if clash:
        raise ValueError(f"columns {clash} are in the left side already; give a prefix")
    back = direction == "backward"
    dtype = left.schema[left_time].dataType
    named = [f"_la_k{i}" for i in range(len(keys))]
    own_keys = [F.col(k).alias(n) for k, n in zip(keys, named)]
    rest = [c for c in values if c != right_time]

    valid = F.col(right_time).isNotNull()
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    # At one time: right rows first, unless equal times are not to match.
    value = F.struct(F.col(right_time).cast(dtype).alias("_la_t"), *[F.col(c).alias(f"_la_c{i}") for i, c in enumerate(rest)])
    second = F.lit(1 if allow_exact else 0)
    events = right.where(valid).select(
        *own_keys, F.col(right_time).cast(dtype).alias("_la_t"), (F.lit(1) - second).alias("_la_side"), value.alias("_la_value")
    )
    rows = left.select(*own_keys, F.col(left_time).alias("_la_t"), second.alias("_la_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_la_row"))
    merged = rows.unionByName(events, allowMissingColumns=True)
    merged, block = range_blocks(merged, named, ["_la_t"], rows_per_block)

    order = ["_la_t", "_la_side", "_la_value"] if back else [F.desc("_la_t"), "_la_side", F.desc("_la_value")]
    seen = F.last("_la_value", ignorenulls=True)
    if block is None:
        held = merged.withColumn("_la_held", seen.over(Window.partitionBy(*named).orderBy(*order)))
    else:
        edge = F.max("_la_value") if back else F.min("_la_value")
        per_block = merged.groupBy(*named, _BLK).agg(edge.alias("_la_edge"))
        along = F.col(_BLK) if back else F.desc(_BLK)
        before = Window.partitionBy(*named).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        carry = per_block.select(
            *[F.col(n).alias(f"_la_at{i}") for i, n in enumerate(named)], F.col(_BLK).alias("_la_in"),
            F.last("_la_edge", ignorenulls=True).over(before).alias("_la_carry"),
        )
        met = F.col(_BLK) == F.col("_la_in")
        for i, n in enumerate(named):
            met = met & F.col(n).eqNullSafe(F.col(f"_la_at{i}"))
        inside = Window.partitionBy(*named, _BLK).orderBy(*order)
        held = merged.join(carry, met).withColumn("_la_held", F.coalesce(seen.over(inside), F.col("_la_carry")))

    fits = F.lit(True)
    if tolerance is not None:
        far = _distance(F.col("_la_t"), F.col("_la_held._la_t"), dtype) if back else _distance(F.col("_la_held._la_t"), F.col("_la_t"), dtype)
        fits = far <= F.lit(tolerance)
    usable = F.col("_la_t").isNotNull() & fits
    for n in named:
        usable = usable & F.col(n).isNotNull()
    fields = {right_time: "_la_t"} | {c: f"_la_c{i}" for i, c in enumerate(rest)}
    return held.where("_la_row IS NOT NULL").select(
        "_la_row.*", *[F.when(usable, F.col(f"_la_held.{fields[v]}")).alias(prefix + v) for v in values]
    )
