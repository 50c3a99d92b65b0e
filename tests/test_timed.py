"""Joined streams, late events and the load ledger: against plain Python, over several runs, and after failures."""

from __future__ import annotations

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.plans.copy_into import changed_files, copy_into, loaded, manifest
from lakeaudit.streaming import joins, late

T0 = dt.datetime(2024, 3, 1)
DAY = dt.timedelta(days=1)
ORDERS = "o_id int, o_at timestamp, note string"
DELIVERIES = "d_id int, d_at timestamp"


def land(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_outer_join_over_several_runs(spark, scratch):
    """One order has a third of the deliveries; unmatched orders come out once their time has passed, and only then."""
    rng = random.Random(3)
    orders = [(i, T0 + DAY * rng.randrange(0, 60), "x") for i in range(60)] + [(None, T0, "no key"), (7, None, "no time")]
    deliveries = [(1 if rng.random() < 0.35 else rng.randrange(0, 80), T0 + DAY * rng.randrange(0, 80)) for _ in range(150)]
    far = T0 + DAY * 200
    portions = [(orders[:30], deliveries[:70]), (orders[30:], deliveries[70:]), ([(900, far, "late mark")], [(901, far)])]
    runs = []
    for number, (a, b) in enumerate(portions):
        # every portion arrives in time order, so nothing falls behind the watermark
        land(spark, a, ORDERS, f"{scratch}/orders")
        land(spark, b, DELIVERIES, f"{scratch}/deliveries")
        if number == 0:
            continue
        side = lambda name, schema: (f"{scratch}/{name}", spark.createDataFrame([], schema).schema, "*.parquet")
        args = (side("orders", ORDERS), side("deliveries", DELIVERIES), f"{scratch}/sink", f"{scratch}/checkpoint", [("o_id", "d_id")], "o_at", "d_at", "10 days", "1 day", "1 day")
        joins.joined_ingest(spark, *args)
        runs.append(Counter((r.o_id, r.o_at, r.d_at) for r in spark.read.parquet(f"{scratch}/sink").collect()))
    expected, open_ = Counter(), Counter()
    mark = min(max(o[1] for o in orders if o[1]), max(d[1] for d in deliveries)) - DAY
    for o, at, _ in orders:
        if at is None:
            continue
        met = [d for k, d in deliveries if k == o and at <= d <= at + 10 * DAY]
        if met:
            expected.update((o, at, d) for d in met)
        elif at + 10 * DAY < mark:
            expected[o, at, None] += 1
        else:
            open_[o, at, None] += 1
    assert runs[0] == expected and open_
    assert runs[1] == expected + open_  # the far watermark closes the rest
    before = runs[1]
    joins.joined_ingest(spark, *args)  # nothing new
    assert Counter((r.o_id, r.o_at, r.d_at) for r in spark.read.parquet(f"{scratch}/sink").collect()) == before
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_outer_join_of_batches_and_clashing_names(spark):
    a, b = spark.createDataFrame([(1, T0, "x"), (2, T0, "y")], ORDERS), spark.createDataFrame([(1, T0 + DAY)], DELIVERIES)
    got = joins.outer_join_streams(a, b, [("o_id", "d_id")], "o_at", "d_at", "2 days").collect()
    assert sorted((r.o_id, r.d_id) for r in got if r.d_id) == [(1, 1)] and len(got) == 2
    with pytest.raises(ValueError, match="rename"):
        joins.outer_join_streams(a, a, [], "o_at", "o_at", "1 day")


EVENTS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("ts", T.TimestampNTZType())])


def outputs(spark, sink):
    return {r: Counter((x.id, x.batch) for x in late.routed_rows(spark, sink, r, EVENTS).collect()) for r in (late.ON_TIME, late.LATE)}


def test_every_event_is_in_exactly_one_output(spark, scratch):
    rng = random.Random(5)
    expected = {late.ON_TIME: Counter(), late.LATE: Counter()}
    seen = None
    for batch in range(4):
        rows = [(batch * 100 + i, None if rng.random() < 0.05 else T0 + dt.timedelta(seconds=batch * 5_000 + rng.randrange(-9_000, 5_000))) for i in range(50)]
        if batch == 2:
            rows = [(i, T0 - DAY) for i, _ in rows]  # all late
        land(spark, rows, EVENTS, f"{scratch}/in")
        assert late.split_late(spark, f"{scratch}/in", EVENTS, f"{scratch}/sink", f"{scratch}/ck", "ts", 3600)["num_input_rows"] in (50, None)
        for i, ts in rows:
            behind = ts is None or (seen is not None and ts < seen - dt.timedelta(hours=1))
            expected[late.LATE if behind else late.ON_TIME][i, batch] += 1
        seen = max(t for t in [seen, *(t for _, t in rows)] if t is not None)
    assert outputs(spark, f"{scratch}/sink") == expected and expected[late.LATE]
    late.split_late(spark, f"{scratch}/in", EVENTS, f"{scratch}/sink", f"{scratch}/ck", "ts", 3600)  # nothing new
    assert outputs(spark, f"{scratch}/sink") == expected
    counted = {r.batch: (r.on_time_rows, r.late_rows) for r in late.marks(spark, f"{scratch}/sink").collect()}
    assert counted == {b: tuple(sum(n for (_, x), n in expected[r].items() if x == b) for r in (late.ON_TIME, late.LATE)) for b in range(4)}


def test_a_batch_without_its_mark_is_not_read_and_its_repeat_replaces_it(spark, scratch):
    first = spark.createDataFrame([(1, T0), (2, T0 + DAY)], EVENTS)
    second = spark.createDataFrame([(3, T0), (4, T0 + 2 * DAY)], EVENTS)
    late.route_batch(first, 0, f"{scratch}/sink", "ts", 60)
    late.route_batch(second, 1, f"{scratch}/sink", "ts", 60)
    whole = outputs(spark, f"{scratch}/sink")
    from lakeaudit.sources.swap import remove_folder

    remove_folder(spark, f"{scratch}/sink/marks/batch=1")  # as if the run had ended before the mark
    assert outputs(spark, f"{scratch}/sink") == {late.ON_TIME: Counter({(1, 0): 1, (2, 0): 1}), late.LATE: Counter()}
    late.route_batch(second, 1, f"{scratch}/sink", "ts", 60)
    assert outputs(spark, f"{scratch}/sink") == whole == {late.ON_TIME: Counter({(1, 0): 1, (2, 0): 1, (4, 1): 1}), late.LATE: Counter({(3, 1): 1})}
    assert late.routed_rows(spark, f"{scratch}/none", late.LATE, EVENTS).collect() == []
    with pytest.raises(ValueError, match="route"):
        late.routed_rows(spark, f"{scratch}/sink", "other", EVENTS)


SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])


def put(folder, name, lines, age):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("".join(f"{i},{x}\n" for i, x in lines))
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def test_copy_into_loads_each_file_once(spark, scratch):
    source, target = f"{scratch}/in", f"{scratch}/table"
    load = lambda **kw: copy_into(spark, source, target, SCHEMA, "csv", pattern="*.csv", **kw)
    held = lambda: sorted((r.id, r.name) for r in loaded(spark, target, SCHEMA).collect())
    assert load() == {"files_seen": 0, "files_loaded": 0, "rows_loaded": 0, "load": 0} and held() == []
    put(source, "a b.csv", [(1, "x"), (2, "y")], 1)
    put(source, "c[1]%20.csv", [(3, "z")], 1)  # characters that paths encode or globs read
    put(source, "ignored.txt", [(9, "no")], 1)
    assert load() == {"files_seen": 2, "files_loaded": 2, "rows_loaded": 3, "load": 1}
    assert load() == {"files_seen": 2, "files_loaded": 0, "rows_loaded": 0, "load": 0}
    put(f"{source}/later", "d.csv", [(4, "hot")] * 50, 2)  # one file with most rows
    put(f"{source}/later", "empty.csv", [], 2)
    assert load() == {"files_seen": 3, "files_loaded": 1, "rows_loaded": 50, "load": 2}  # a file without bytes is not listed
    assert held() == sorted([(1, "x"), (2, "y"), (3, "z"), *[(4, "hot")] * 50])
    put(source, "a b.csv", [(1, "x"), (2, "changed")], 9)  # changed in place: its rows are replaced
    assert load() == {"files_seen": 3, "files_loaded": 1, "rows_loaded": 2, "load": 3}
    rows = sorted([(1, "x"), (2, "changed"), (3, "z"), *[(4, "hot")] * 50])
    assert held() == rows
    assert load(force=True) == {"files_seen": 3, "files_loaded": 3, "rows_loaded": 53, "load": 4}
    assert held() == rows
    assert [(r.load, r.rows) for r in changed_files(spark, target).collect()] == [(3, 2)]
    os.remove(f"{source}/a b.csv")  # gone from the source: its rows stay
    assert load()["files_loaded"] == 0 and held() == rows
    assert manifest(spark, target).count() == 3 and manifest(spark, target, all_loads=True).count() == 7


def test_a_load_that_fails_before_its_manifest_is_not_seen(spark, scratch, monkeypatch):
    source, target = f"{scratch}/in", f"{scratch}/table"
    put(source, "a.csv", [(1, "x")], 1)
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def fail(self, path, *args, **kw):
        if "/files/" in path:
            raise OSError("lost before the manifest")
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", fail)
    with pytest.raises(OSError, match="manifest"):
        copy_into(spark, source, target, SCHEMA, "csv")
    monkeypatch.undo()
    assert os.path.isdir(f"{target}/rows/load=1") and loaded(spark, target, SCHEMA).collect() == []
    assert copy_into(spark, source, target, SCHEMA, "csv")["load"] == 2
    assert [tuple(r) for r in loaded(spark, target, SCHEMA).collect()] == [(1, "x")]
    assert loaded(spark, target, SCHEMA, with_file=True).agg(F.count_distinct("_source_file")).first()[0] == 1
