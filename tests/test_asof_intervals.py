"""As-of and interval joins against brute force, with a hot key and hot bins at a third of the rows."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest

from lakeaudit.operators.asof import asof_join
from lakeaudit.operators.intervals import overlap_join

T0 = dt.datetime(2024, 1, 1)
AT = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)


def asof_brute(left, right, back, exact, tolerance):
    out = Counter()
    for key, t, x in left:
        best = None
        for k, s, v in right:
            if None in (k, s, key, t) or k != key:
                continue
            gap = t - s if back else s - t
            if gap < 0 or (gap == 0 and not exact) or (tolerance is not None and gap > tolerance):
                continue
            if best is None or ((s, v is not None, v or 0) > best[0] if back else (s, v is not None, v or 0) < best[0]):
                best = ((s, v is not None, v or 0), s, v)
        out[key, t, x, best and best[1], best and best[2]] += 1
    return out


@pytest.mark.parametrize("back", [True, False])
@pytest.mark.parametrize("exact,tolerance", [(True, None), (False, None), (True, 40)])
@pytest.mark.parametrize("rows_per_block", [1 << 20, 25])
def test_asof_equals_brute_force(spark, back, exact, tolerance, rows_per_block):
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
    time = lambda: None if rng.random() < 0.03 else int(rng.paretovariate(0.5)) % 500
    left = [(key(), time(), i % 50) for i in range(400)]
    right = [(key(), time(), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    a = spark.createDataFrame([(k, AT(t), x) for k, t, x in left], "k string, at timestamp, x int")
    b = spark.createDataFrame([(k, AT(t), v) for k, t, v in right], "k string, since timestamp, v int")
    got = asof_join(a, b, "k", "at", "since", ["since", "v"], tolerance, "backward" if back else "forward", exact, rows_per_block=rows_per_block)
    seconds = lambda t: None if t is None else int((t - T0).total_seconds())
    assert got.columns == ["k", "at", "x", "since", "v"]
    assert Counter((r.k, seconds(r.at), r.x, seconds(r.since), r.v) for r in got.collect()) == asof_brute(left, right, back, exact, tolerance)


def test_asof_block_of_a_hot_key_stays_small(spark):
    """A key with all rows is dealt to many (key, block) groups, and a value from blocks ago is carried in."""
    left = spark.range(20_000).selectExpr("1 AS k", "id AS t")
    right = spark.createDataFrame([(1, 5, "early")], "k int, t long, v string")
    got = asof_join(left, right, "k", "t", "t", ["v"], rows_per_block=1_000)
    assert {(r.v, r["count"]) for r in got.groupBy("v").count().collect()} == {(None, 5), ("early", 19_995)}
    text = got._jdf.queryExecution().toString()
    assert "_la_block" in text and "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_asof_of_empty_sides_and_clashing_names(spark):
    left = spark.createDataFrame([("a", 1)], "k string, t long")
    right = spark.createDataFrame([], "k string, t long, v int")
    assert [tuple(r) for r in asof_join(left, right, ["k"], "t", "t", ["v"]).collect()] == [("a", 1, None)]
    assert asof_join(left.limit(0), right, ["k"], "t", "t", ["v"]).collect() == []
    with pytest.raises(ValueError, match="prefix"):
        asof_join(left, right, "k", "t", "t", ["t"])
    assert asof_join(left, right, "k", "t", "t", ["t"], prefix="r_").columns == ["k", "t", "r_t"]


def spans(rng, n, hot):
    out = []
    for i in range(n):
        s = hot if rng.random() < 0.35 else rng.randrange(-5_000, 5_000)
        e = s + rng.choice([0, 0, 1, 3, 4, 15, 16, 17, 64, 300, 5_000, -2])
        out.append((i % (n - 5), None if rng.random() < 0.02 else s, None if rng.random() < 0.02 else e, rng.choice(["x", "y", None])))
    return out


@pytest.mark.parametrize("open_end", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("kind", ["long", "timestamp", "double"])
def test_overlaps_equal_brute_force(spark, open_end, keyed, kind):
    rng = random.Random(11)
    left, right = spans(rng, 150, 17), spans(rng, 130, 17)
    value = {"long": lambda x: x, "timestamp": AT, "double": lambda x: None if x is None else x / 8}[kind]
    frames = [
        spark.createDataFrame([(i, value(s), value(e), k) for i, s, e, k in rows], f"id int, s {kind}, e {kind}, k string") for rows in (left, right)
    ]
    got = overlap_join(*frames, ("s", "e"), ("s", "e"), ["k"] if keyed else [], open_end, "l_", "r_")
    expected = Counter()
    for i, s, e, k in left:
        for j, s2, e2, k2 in right:
            if None in (s, e, s2, e2) or (keyed and (k is None or k != k2)):
                continue
            if open_end and s < e and s2 < e2 and s < e2 and s2 < e or not open_end and s <= e and s2 <= e2 and s <= e2 and s2 <= e:
                expected[i, j] += 1
    assert Counter((r.l_id, r.r_id) for r in got.select("l_id", "r_id").collect()) == expected and sum(expected.values()) > 300
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_a_long_interval_is_copied_a_few_times(spark):
    """Two bins to be filed and two for each level in use, whatever its length."""
    long_ = spark.createDataFrame([(0, 10**15)], "s long, e long")
    points = spark.range(2_000).selectExpr("id * 100000 AS s", "id * 100000 AS e")
    joined = overlap_join(long_, points, ("s", "e"), ("s", "e"), left_prefix="l_", right_prefix="r_")
    assert joined.count() == 2_000
    assert overlap_join(points, long_.limit(0), ("s", "e"), ("s", "e"), left_prefix="l_", right_prefix="r_").collect() == []
