"""Trails against an automaton, also in small blocks, with a hot trail and odd rows."""

from __future__ import annotations

import random

import pytest

from lakeaudit.operators.conformance import conformance
from lakeaudit.plans.timed import SHOP_FLOW


def brute(rows):
    trails = {}
    for key, seq, event in rows:
        trails.setdefault(key, []).append((seq, event))
    out = {}
    for key, events in trails.items():
        state, bad, first = "idle", 0, None
        for seq, event in sorted(events, key=lambda x: x[0]):
            if (state, event) in SHOP_FLOW:
                state = SHOP_FLOW[state, event]
            else:
                bad += 1
                first = seq if first is None else first
        out[key] = (len(events), bad, first, state)
    return out


@pytest.mark.parametrize("rows_per_block", [1 << 16, 40, 3])
def test_conformance_equals_brute_force(spark, rows_per_block):
    rng = random.Random(9)
    kinds = ["view", "click", "purchase", "signup", "error", "view", "click", "unknown", None]
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), i, rng.choice(kinds)) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, seq int, event string, n_events int")
    got = conformance(df, "k", ["seq"], "event", SHOP_FLOW, "idle", rows_per_block).collect()
    expected = brute(rows)
    assert len(got) == len(expected)
    for r in got:
        assert (r.n_events, r.n_violations, r.first_violation and r.first_violation.seq, r.end_state) == expected[r.k]
    assert conformance(df.limit(0), "k", ["seq"], "event", SHOP_FLOW, "idle", rows_per_block).collect() == []


def test_an_automaton_without_events_is_refused(spark):
    with pytest.raises(ValueError, match="no event"):
        conformance(spark.createDataFrame([(1, 1, "x")], "k int, s int, e string"), "k", ["s"], "e", {}, "idle")
