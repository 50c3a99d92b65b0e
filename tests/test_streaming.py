"""Bronze ingest and windowed counts with Structured Streaming (G1, G2):
duplicates within the watermark, an event later than the watermark, a rerun
with no new file."""

from __future__ import annotations

import datetime as dt
import os

from lakeaudit.streaming import bronze

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _land(spark, folder, name, rows):
    """Land one batch as its own folder of Parquet files; the stream reads
    ``landing/*`` so each batch folder is picked up once."""
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


def _t(h, m=0):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=h, minutes=m)


def test_bronze_dedupe_and_rerun(spark, scratch):
    landing = os.path.join(scratch, "landing")
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    _land(spark, landing, "f1", [
        (1, _t(0), 1, "view", 1.0, "{}"),
        (1, _t(0, 10), 1, "view", 1.0, "{}"),  # duplicate id within the watermark
        (2, _t(1), 2, "click", 2.0, "{}"),
    ])
    bronze.bronze_ingest(spark, landing + "/*", SCHEMA, sink, ckpt, path_glob="*.parquet", watermark="1 hour")
    assert sorted(r["event_id"] for r in spark.read.parquet(sink).collect()) == [1, 2]
    # rerun with no new file adds nothing
    info = bronze.bronze_ingest(spark, landing + "/*", SCHEMA, sink, ckpt, path_glob="*.parquet")
    assert info["num_input_rows"] == 0
    assert spark.read.parquet(sink).count() == 2
    # a new file with a repeat of id 2 (still within the watermark) and a new id
    _land(spark, landing, "f2", [(2, _t(1, 5), 2, "click", 2.0, "{}"), (3, _t(2), 3, "buy", 3.0, "{}")])
    bronze.bronze_ingest(spark, landing + "/*", SCHEMA, sink, ckpt, path_glob="*.parquet")
    assert sorted(r["event_id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_windows_drop_late_events(spark, scratch):
    landing = os.path.join(scratch, "landing")
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    # batch 1: events on day 1 and one on day 3 (watermark moves to day 3 − 1h)
    _land(spark, landing, "f1", [
        (1, _t(1), 1, "view", 1.0, "{}"),
        (2, _t(2), 1, "view", 2.0, "{}"),
        (3, _t(49), 1, "view", 4.0, "{}"),
    ])
    bronze.windowed_ingest(spark, landing + "/*", SCHEMA, sink, ckpt, window="1 day", watermark="1 hour",
                           path_glob="*.parquet")
    # batch 2: a day-1 event, later than the watermark → dropped
    _land(spark, landing, "f2", [(4, _t(3), 1, "view", 8.0, "{}"), (5, _t(50), 1, "view", 16.0, "{}")])
    bronze.windowed_ingest(spark, landing + "/*", SCHEMA, sink, ckpt, window="1 day", watermark="1 hour",
                           path_glob="*.parquet")
    rows = {r["window_start"]: (r["events"], float(r["value"])) for r in spark.read.parquet(sink).collect()}
    # day 1 closed with the two on-time events; day 3 is still open
    assert rows == {dt.datetime(2025, 1, 1): (2, 3.0)}


def test_gated_csv_stream(spark, scratch):
    import csv as pycsv

    from lakeaudit.contracts import CUSTOMERS

    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)

    def land(name, rows):
        with open(os.path.join(landing, name), "w", newline="") as f:
            w = pycsv.writer(f)
            w.writerow(CUSTOMERS.column_names)
            w.writerows(rows)

    land("a.csv", [["c1", "US", "t1", "low", "2024-01-01", ""], ["c2", "", "t1", "low", "2024-01-01", ""]])
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    assert bronze.gated_csv_ingest(spark, landing, CUSTOMERS, sink, ckpt)["num_input_rows"] == 2
    assert bronze.gated_csv_ingest(spark, landing, CUSTOMERS, sink, ckpt)["num_input_rows"] == 0
    land("b.csv", [["c3", "MX", "t2", "high", "not-a-date", ""]])
    bronze.gated_csv_ingest(spark, landing, CUSTOMERS, sink, ckpt)
    good_df, bad_df = bronze.gated_sink_parts(spark, sink)
    good = sorted(r["customer_id"] for r in good_df.collect())
    bad = {r["customer_id"]: list(r["reasons"]) for r in bad_df.collect()}
    assert good == ["c1"]
    assert bad["c2"] == ["null:registration_country"]
    assert "parse_error" in bad["c3"]


def test_stream_windows_equal_batch_on_closed_windows(spark, scratch):
    """On the events table: the stream's closed daily windows equal the batch
    aggregate restricted to windows the final watermark has passed, and a
    rerun reads nothing new."""
    from pyspark.sql import functions as F

    from tests.conftest import SF_SMALL

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    bronze.windowed_ingest(spark, SF_SMALL, events.schema, sink, ckpt, path_glob="events.parquet")
    again = bronze.windowed_ingest(spark, SF_SMALL, events.schema, sink, ckpt, path_glob="events.parquet")
    assert again["num_input_rows"] == 0
    streamed = sorted(spark.read.parquet(sink).select("window_start", "event_type", "events").collect())
    watermark = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    batch = (events.groupBy(day.alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("events"))
             .filter(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(watermark)))
    assert streamed == sorted(batch.collect())
    assert len(streamed) > 0
