"""Timestamp helpers. Timestamps of the driver's data are TIMESTAMP_NTZ; the
session zone is pinned to UTC, so epoch arithmetic on them is wall-clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeaudit.functions._util import col_of


def seconds_between(start, end) -> Column:
    """Second boundaries crossed from ``start`` to ``end`` (negative when end is
    earlier): ``floor(end) − floor(start)`` in epoch seconds."""
    return F.unix_timestamp(col_of(end)) - F.unix_timestamp(col_of(start))
