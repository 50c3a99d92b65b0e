"""Audit-trail sequence check.

Per trail (a transaction's audit events) the sequence numbers should run
1, 2, 3, … with the wall clock never going backwards. Each row is compared with
its predecessor in (sequence, clock) order; the predecessor comes from
``lag_blocked``, which splits a long trail into sequence blocks so one huge
trail is not a single task. The per-trail summary is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.operators.segmented import (
    lag_blocked,
    ordered_blocked,
    range_blocks,
    seq_block,
)


def trail_steps(
    df: DataFrame,
    trail: str = "tx_id",
    seq: str = "sequence_num",
    clock: str = "wall_clock_ts",
    tie: Sequence[str] = (),
    block_width: int | None = None,
    rows_per_block: int = 1 << 20,
) -> DataFrame:
    """Each event with its predecessor's sequence number and clock, and flags:
    ``is_gap`` (seq > prev + 1), ``is_duplicate`` (seq = prev), ``is_backwards``
    (clock < prev clock). ``tie`` columns complete the order for equal
    (seq, clock) pairs; flags do not depend on them. Blocks are cut
    by the rows' ranges unless ``block_width`` is given; when no trail exceeds
    ``rows_per_block`` events, a plain per-trail window is used."""
    order = [seq, clock, *tie]
    if block_width:
        blocked, block = df, seq_block(F.col(seq), block_width)
    else:
        blocked, block = range_blocks(df, trail, order, rows_per_block)
    out = lag_blocked(blocked, trail, order, [seq, clock], block)
    prev_seq = F.col(f"prev_{seq}")
    prev_clock = F.col(f"prev_{clock}")
    return out.select(
        *df.columns,
        prev_seq.alias("prev_seq"),
        prev_clock.alias("prev_clock"),
        F.coalesce(F.col(seq) > prev_seq + 1, F.lit(False)).alias("is_gap"),
        F.coalesce(F.col(seq) == prev_seq, F.lit(False)).alias("is_duplicate"),
        F.coalesce(F.col(clock) < prev_clock, F.lit(False)).alias("is_backwards"),
    )


def trail_summary(
    df: DataFrame,
    trail: str = "tx_id",
    seq: str = "sequence_num",
    clock: str = "wall_clock_ts",
    tie: Sequence[str] = (),
    block_width: int | None = None,
    rows_per_block: int = 1 << 20,
) -> DataFrame:
    """One row per trail: event count, first/last sequence number, number of
    gaps, duplicates and backward clock steps, and ``is_clean``."""
    steps = trail_steps(df, trail, seq, clock, tie, block_width, rows_per_block)
    s = steps.groupBy(trail).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
        F.min(seq).cast("bigint").alias("first_seq"),
        F.max(seq).cast("bigint").alias("last_seq"),
        F.count(F.when(F.col("is_gap"), 1)).cast("bigint").alias("n_gaps"),
        F.count(F.when(F.col("is_duplicate"), 1)).cast("bigint").alias("n_duplicates"),
        F.count(F.when(F.col("is_backwards"), 1)).cast("bigint").alias("n_backwards"),
    )
    clean = (
        (F.col("first_seq") == 1)
        & (F.col("n_gaps") == 0)
        & (F.col("n_duplicates") == 0)
        & (F.col("n_backwards") == 0)
    )
    return s.withColumn("is_clean", clean)


def numbered_trail_summary(
    df: DataFrame,
    trail: str,
    order: Sequence[str],
    block,
    clock: str,
    seq: str = "sequence_num",
) -> DataFrame:
    """C6 for trails that carry no sequence column: the sequence number is the
    rank along ``order`` (e.g. an event id). Numbering and the predecessor come from one
    block-split pass. Ranks have no gaps; a row whose ``order`` values equal its
    predecessor's states the same event again and counts as a duplicate."""
    order = list(order)
    total = [*order, clock]  # rows equal in these are alike for every check
    steps = ordered_blocked(df, trail, total, block, row_number=seq, lag_cols=total)
    repeats = F.col(seq) > 1
    for name in order:
        repeats = repeats & F.col(name).eqNullSafe(F.col(f"prev_{name}"))
    s = steps.groupBy(trail).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
        F.min(seq).cast("bigint").alias("first_seq"),
        F.max(seq).cast("bigint").alias("last_seq"),
        F.lit(0).cast("bigint").alias("n_gaps"),
        F.count(F.when(repeats, 1)).cast("bigint").alias("n_duplicates"),
        F.count(F.when(F.col(clock) < F.col(f"prev_{clock}"), 1)).cast("bigint").alias("n_backwards"),
    )
    clean = (F.col("first_seq") == 1) & (F.col("n_duplicates") == 0) & (F.col("n_backwards") == 0)
    return s.withColumn("is_clean", clean)
