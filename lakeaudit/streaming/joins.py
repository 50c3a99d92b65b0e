"""Two streams joined in time, with unmatched rows (C2 and C3 while the data arrives).

``outer_join_streams`` joins each left row (an order) with the right rows of its key (its
deliveries) that come within ``within`` of it, and keeps a left row without any: it is written
with nulls once the watermark says that no delivery in time can still arrive. Both sides
carry a watermark and the join states the time range, so Spark drops a row from either side's state as
soon as its range has passed; the state holds about ``within`` plus the delays of each stream, not all rows.

The state of both sides lives in RocksDB on the executors with changelog checkpoints, so it may
be larger than memory and a lost executor's part is restored from the checkpoint folder.
A query started again goes on where it stopped; a run with no new file adds nothing.

Which left rows come out unmatched: those whose range ends before the watermark, the smaller
of both streams' greatest times minus their delays. Later ones stay in the state for the next run.
Rows that arrive behind the watermark are dropped by the engine (``streaming.late`` keeps such rows).
Rows with a null key or time: a null key on the left matches nothing and comes out unmatched in its turn; a null
time takes no part on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.streaming.bronze import file_stream, run_available_now

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_L, _R = "_la_left_time", "_la_right_time"


def outer_join_streams(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    within: str,
    left_delay: str = "1 hour",
    right_delay: str = "1 hour",
) -> DataFrame:
    """All columns of both sides, whose names must differ; ``on`` pairs a left and a right column.

    A right row fits if its time is not before the left row's and at most ``within`` (an interval such as
    ``60 days``) after it. Works on two batch frames as well, where every unmatched left row comes out.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}; rename one side")
    a = left.where(F.col(left_time).isNotNull()).withColumn(_L, F.col(left_time).cast("timestamp")).withWatermark(_L, left_delay)
    b = right.where(F.col(right_time).isNotNull()).withColumn(_R, F.col(right_time).cast("timestamp")).withWatermark(_R, right_delay)
    fits = (F.col(_R) >= F.col(_L)) & (F.col(_R) <= F.col(_L) + F.expr(f"INTERVAL {within}"))
    for own, other in on:
        fits = fits & (F.col(own) == F.col(other))
    return a.join(b, fits, "left_outer").drop(_L, _R)


def joined_ingest(
    spark: SparkSession,
    left: tuple[str, T.StructType, str],
    right: tuple[str, T.StructType, str],
    sink_path: str,
    checkpoint: str,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    within: str,
    left_delay: str = "1 hour",
    right_delay: str = "1 hour",
    columns: Sequence[str] | None = None,
) -> dict:
    """Both landing folders (folder, schema, file pattern) joined into a Parquet sink; the progress as of ``run_available_now``."""
    sides = [file_stream(spark, folder, schema, path_glob=pattern) for folder, schema, pattern in (left, right)]
    joined = outer_join_streams(*sides, on, left_time, right_time, within, left_delay, right_delay)
    if columns:
        joined = joined.select(*columns)
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    try:
        for key, value in STATE_SETTINGS.items():
            spark.conf.set(key, value)
        return run_available_now(joined, sink_path, checkpoint)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
