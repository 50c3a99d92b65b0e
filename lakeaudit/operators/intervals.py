"""Interval join: pairs of intervals that overlap, with or without an equi key.

A join whose only condition is ``a.start <= b.end AND b.start <= a.end`` has no key to
shuffle on. ``overlap_join`` gives it one: an index of bins on several levels. Bins of
level k are ``FACTOR``^k units wide. An interval is filed on the first level whose bins
are no shorter than itself, so it lies in one or two bins, however long it is; the other
side looks it up with the one or two bins it covers on each level in use. An interval
is thus copied at most twice to be filed, and twice for each level that the other side uses
at or above its own (distinct levels are a small aggregate; a side has 32 of them at
most), never once for each unit it covers.

Every overlapping pair meets on the longer interval's level, by the shorter one's look-up (on a tie of
levels the left side is filed), and is kept in the bin that holds the later of the two starts.
So each pair comes out once, with no distinct, and the condition itself is checked again on the bounds.
Filed and look-up rows are plain projections of their inputs, so adaptive execution splits a
bin that holds a large share of the rows.

Defined cases: bounds are inclusive, a point is an interval with equal bounds; with ``open_end`` the end is not part
of the interval and one of no length overlaps nothing; intervals with a null bound or an end before the start never
match; equal rows are rows of their own; with ``keys``, only rows with equal, non-null keys meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTOR = 4
LEVELS = 32


def _units(name: str, dtype: T.DataType) -> Column:
    """The bound as whole units: microseconds, days, or the number itself rounded down."""
    c = F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dtype, T.IntegralType):
        return c.cast("long")
    return F.floor(c).cast("long")


def _level(length: Column) -> Column:
    """The first level whose bins are at least ``length`` + 1 units wide."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length < F.lit(FACTOR**k), F.lit(k)).otherwise(out)
    return out


def _width(level: Column) -> Column:
    """``FACTOR`` to the power of the level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (level * F.lit(FACTOR.bit_length() - 1)).cast("int"))


def _bins(start: Column, end: Column, level: Column) -> Column:
    width = _width(level)
    first, last = _div(start, width), _div(end, width)
    return F.when(first == last, F.array(first)).otherwise(F.array(first, last))


def _div(x: Column, width: Column) -> Column:
    """Whole-number division, rounded down; a quotient of doubles would lose units beyond 2^53."""
    return F.call_function("div", x - F.pmod(x, width), width)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    keys: str | Sequence[str] = (),
    open_end: bool = False,
    left_prefix: str = "",
    right_prefix: str = "",
) -> DataFrame:
    """All columns of both sides (prefixed) for every pair of overlapping intervals; ``keys`` name columns of both sides."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = [left_prefix + c for c in left.columns] + [right_prefix + c for c in right.columns if c not in keys]
    if len(set(names)) < len(names):
        raise ValueError("both sides have columns of one name; give prefixes")

    def side(df: DataFrame, bounds: tuple[str, str], mark: str) -> DataFrame:
        start, end = bounds
        ok = F.col(start) < F.col(end) if open_end else F.col(start) <= F.col(end)
        for k in keys:
            ok = ok & F.col(k).isNotNull()
        units = df.where(ok).select(
            F.struct(*[F.col(c) for c in df.columns]).alias(f"{mark}_row"), *[F.col(k).alias(f"{mark}_k{i}") for i, k in enumerate(keys)],
            F.col(start).alias(f"{mark}_from"), F.col(end).alias(f"{mark}_to"),
            _units(start, df.schema[start].dataType).alias(f"{mark}_s"), _units(end, df.schema[end].dataType).alias(f"{mark}_e"),
        )
        return units.withColumn(f"{mark}_level", _level(F.col(f"{mark}_e") - F.col(f"{mark}_s")))

    a, b = side(left, left_bounds, "a"), side(right, right_bounds, "b")

    def filed(df: DataFrame, mark: str) -> DataFrame:
        own = F.col(f"{mark}_level")
        return df.select("*", own.alias(f"{mark}_at"), F.explode(_bins(F.col(f"{mark}_s"), F.col(f"{mark}_e"), own)).alias(f"{mark}_bin"))

    def looked_up(df: DataFrame, mark: str, levels: list[int], also_equal: bool) -> DataFrame:
        above = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: (k >= F.col(f"{mark}_level")) if also_equal else (k > F.col(f"{mark}_level")))
        each = df.select("*", F.explode(above).alias(f"{mark}_at"))
        return each.select("*", F.explode(_bins(F.col(f"{mark}_s"), F.col(f"{mark}_e"), F.col(f"{mark}_at"))).alias(f"{mark}_bin"))

    def used(df: DataFrame, mark: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"{mark}_level").distinct().collect())  # at most LEVELS numbers

    met = (F.col("a_at") == F.col("b_at")) & (F.col("a_bin") == F.col("b_bin"))
    for i in range(len(keys)):
        met = met & (F.col(f"a_k{i}") == F.col(f"b_k{i}"))
    home = _div(F.greatest("a_s", "b_s"), _width(F.col("a_at"))) == F.col("a_bin")
    if open_end:
        overlap = (F.col("a_from") < F.col("b_to")) & (F.col("b_from") < F.col("a_to"))
    else:
        overlap = (F.col("a_from") <= F.col("b_to")) & (F.col("b_from") <= F.col("a_to"))
    parts = []
    levels_a, levels_b = used(a, "a"), used(b, "b")
    if levels_a and levels_b:
        parts = [
            filed(a, "a").join(looked_up(b, "b", levels_a, True), met).where(home & overlap),
            looked_up(a, "a", levels_b, False).join(filed(b, "b"), met).where(home & overlap),
        ]
    out_cols = [F.col(f"a_row.{c}").alias(left_prefix + c) for c in left.columns] + [
        F.col(f"b_row.{c}").alias(right_prefix + c) for c in right.columns if c not in keys
    ]
    if not parts:  # one side has no interval at all
        return a.join(b, F.lit(False)).select(*out_cols)
    return parts[0].select(*out_cols).unionByName(parts[1].select(*out_cols))
