"""Bronze ingest and event windows with Structured Streaming.

The reference schedules an hourly "Bronze Ingest - Events" job and keeps a
checkpoints folder; it computes nothing. Here the job is an incremental file
stream:

* each new file in the landing folder is read once (the checkpoint records
  what was read, so a rerun with no new file adds nothing);
* ``trigger(availableNow=True)`` processes whatever has landed and stops, which
  is how an hourly schedule drives a stream;
* duplicates of the event key are dropped within the watermark
  (``dropDuplicatesWithinWatermark``), so the dedupe state stays bounded;
* windowed counts use the same watermark and append mode: a window is written
  once, when the watermark passes its end, and events later than that are
  dropped. At the end of a drained stream the last windows are still open.

The driver's timestamps are TIMESTAMP_NTZ, which ``withWatermark`` rejects; they
are cast to TIMESTAMP under the UTC session zone (wall-clock unchanged) for the
watermark and cast back on output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EVT = "_event_time"


def file_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    path_glob: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Incremental file source over a landing folder (explicit schema)."""
    r = spark.readStream.format(fmt).schema(schema)
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def with_event_time(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withColumn(_EVT, F.col(ts).cast("timestamp")).withWatermark(_EVT, watermark)


def dedupe_events(stream: DataFrame, key: Sequence[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """G1 transformation: drop repeats of ``key`` arriving within the watermark."""
    return with_event_time(stream, ts, watermark).dropDuplicatesWithinWatermark(list(key)).drop(_EVT)


def window_counts(
    stream: DataFrame,
    ts: str,
    window: str = "1 day",
    by: Sequence[str] = ("event_type",),
    value: str | None = "value",
    watermark: str = "1 hour",
) -> DataFrame:
    """G2 transformation: tumbling-window counts (and Σ value in DECIMAL)."""
    timed = with_event_time(stream, ts, watermark)
    aggs = [F.count(F.lit(1)).cast("bigint").alias("events")]
    if value:
        aggs.append(F.sum(F.col(value).cast("decimal(12,2)")).cast("decimal(22,2)").alias("value"))
    out = timed.groupBy(F.window(_EVT, window).alias("w"), *by).agg(*aggs)
    return out.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        *by,
        *[a for a in ("events", "value") if a in out.columns],
    )


def _drain(query) -> dict:
    """Wait for an available-now query; ``batch_id`` and the input rows of all its batches.

    Only the newest progress reports are kept by a query, so they are gathered while it
    runs. Should a report have been missed, ``num_input_rows`` is None, never a part.
    """
    rows: dict[int, int] = {}
    done = False
    while not done:
        done = query.awaitTermination(1)
        for p in query.recentProgress:
            rows[p["batchId"]] = max(rows.get(p["batchId"], 0), p["numInputRows"])
    whole = not rows or len(rows) == max(rows) - min(rows) + 1
    return {"batch_id": max(rows, default=None), "num_input_rows": sum(rows.values()) if whole else None}


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet") -> dict:
    """Process everything that has landed, write it to ``sink_path`` and stop.
    Returns the last progress summary (input rows, batch id)."""
    q = (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink_path)
    )
    return _drain(q)


def bronze_ingest(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType | str,
    sink_path: str,
    checkpoint: str,
    key: Sequence[str] = ("event_id",),
    ts: str = "ts",
    watermark: str = "1 hour",
    path_glob: str | None = None,
) -> dict:
    """G1 end to end: landing folder → dedupe within watermark → Parquet sink."""
    stream = file_stream(spark, source_dir, schema, path_glob=path_glob)
    return run_available_now(dedupe_events(stream, key, ts, watermark), sink_path, checkpoint)


def windowed_ingest(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType | str,
    sink_path: str,
    checkpoint: str,
    ts: str = "ts",
    window: str = "1 day",
    by: Sequence[str] = ("event_type",),
    value: str | None = "value",
    watermark: str = "1 hour",
    path_glob: str | None = None,
) -> dict:
    """G2 end to end: closed windows appended to a Parquet sink."""
    stream = file_stream(spark, source_dir, schema, path_glob=path_glob)
    return run_available_now(
        window_counts(stream, ts, window, by, value, watermark), sink_path, checkpoint
    )


def gated_csv_ingest(
    spark: SparkSession,
    landing_dir: str,
    contract,
    sink_path: str,
    checkpoint: str,
    multi_line: bool = False,
    timestamp_format: str | None = None,
) -> dict:
    """Incremental CSV landing → contract gate → Parquet, as one stream.

    Each new file is read once (typed, PERMISSIVE, malformed lines kept in
    ``_corrupt_record``), every row is tagged with its reasons, and the rows
    are written partitioned by ``is_rejected``: good rows under
    ``is_rejected=false``, quarantined rows with reasons and the raw line under
    ``is_rejected=true``. A rerun with no new file adds nothing.
    """
    from lakeaudit.contracts import CSV_TIMESTAMP_FORMAT
    from lakeaudit.operators.gate import tag
    from lakeaudit.sources.csv import header_schema, read_options, read_schema

    options = read_options(multi_line, timestamp_format or CSV_TIMESTAMP_FORMAT)
    ordered = header_schema(spark, landing_dir, contract.schema(), options)
    stream = spark.readStream.schema(read_schema(ordered)).options(**options).csv(landing_dir)
    stream = stream.select(*read_schema(contract).fieldNames())
    tagged = tag(stream, contract)
    q = (
        tagged.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("is_rejected")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink_path)
    )
    return _drain(q)


def gated_sink_parts(spark: SparkSession, sink_path: str) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantined)`` rows of a gated sink. The stream's file log is
    read (only committed files), and the partition flag comes back as text, so
    it is compared as such."""
    out = spark.read.parquet(sink_path)
    rejected = F.lower(F.col("is_rejected").cast("string")) == F.lit("true")
    return out.filter(~rejected), out.filter(rejected)
