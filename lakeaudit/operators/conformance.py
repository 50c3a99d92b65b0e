"""Trail conformance (C6): do the events of every trail come in an allowed order?

The allowed orders are an automaton: from a state, an event that is allowed leads to the next
state; any other event is a violation and leaves the state as it is.

A trail is judged without ever being in one task as a whole. ``range_blocks`` deals the trails that are
too busy into blocks of about ``rows_per_block`` events along their order. A block does not know the state in
which it begins, so it is run from each of the automaton's few states: its result is a map from the state
at its begin to the state at its end, with the violations met on the way. Maps compose, so a trail's
outcome is one pass over its blocks' maps (one small row for each block) from the start state.

Defined cases: an event that the automaton does not name, or null, is a violation in every state; a null key is a trail of its own;
``order`` must be total within a trail for a repeatable answer; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.operators.segmented import range_blocks

ROWS_PER_BLOCK = 1 << 16


def conformance(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    event: str,
    allowed: Mapping[tuple[str, str], str],
    start: str,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row a trail: ``keys``, n_events, n_violations, first_violation (a struct of the ``order`` columns, null if none) and end_state.

    ``allowed`` maps (state, event) to the next state.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    states = sorted({start, *(s for s, _ in allowed), *allowed.values()})
    events = sorted({e for _, e in allowed})
    if not events:
        raise ValueError("the automaton allows no event")
    width = len(events) + 1  # the last place is every other event
    steps = [states.index(allowed[s, e]) if e is not None and (s, e) in allowed else -1 for s in states for e in [*events, None]]
    table = F.array(*[F.lit(x) for x in steps])
    code = F.lit(len(events))
    for place, name in enumerate(events):
        code = F.when(F.col(event) == name, F.lit(place)).otherwise(code)

    rows = df.select(*keys, *[c for c in order if c not in keys], code.alias("_la_code"))
    blocked, block = range_blocks(rows, keys, list(order), rows_per_block)
    at = F.struct(*[F.col(c) for c in order])
    types = rows.select(at.alias("at")).schema["at"].dataType
    begin = lambda s: F.struct(s.alias("s"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(types).alias("first"))

    def one_event(acc: Column, x: Column) -> Column:
        to = F.get(table, acc["s"] * F.lit(width) + x["code"])
        bad = to < 0
        return F.struct(
            F.when(bad, acc["s"]).otherwise(to).alias("s"),
            (acc["n"] + F.when(bad, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("n"),
            F.coalesce(acc["first"], F.when(bad, x["at"])).alias("first"),
        )

    def one_block(acc: Column, x: Column) -> Column:
        own = F.get(x["map"], acc["s"])
        return F.struct(own["s"].alias("s"), (acc["n"] + own["n"]).alias("n"), F.coalesce(acc["first"], own["first"]).alias("first"))

    numbered = blocked.withColumn("_la_in", block if block is not None else F.lit(0))
    per_block = numbered.groupBy(*keys, "_la_in").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("_la_code").alias("code")))).alias("events"))
    maps = per_block.select(
        *keys, "_la_in", F.size("events").cast("long").alias("size"),
        F.transform(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda s: F.aggregate("events", begin(s), one_event)).alias("map"),
    )
    trails = maps.groupBy(*keys).agg(F.sum("size").alias("n_events"), F.sort_array(F.collect_list(F.struct("_la_in", "map"))).alias("blocks"))
    ended = trails.select(*keys, "n_events", F.aggregate("blocks", begin(F.lit(states.index(start))), one_block).alias("end"))
    return ended.select(
        *keys, "n_events", F.col("end.n").alias("n_violations"), F.col("end.first").alias("first_violation"),
        F.get(F.array(*[F.lit(s) for s in states]), F.col("end.s")).alias("end_state"),
    )
