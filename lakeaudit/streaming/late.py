"""Late events to an output of their own (G1): every event in exactly one of on time and late.

A stream's own watermark drops late rows without a trace. Here each batch is routed
before any stateful step: an event is late if its time lies before the watermark that held when its batch
began, which is the greatest time of all earlier batches minus the allowed delay; an event
without a time is late, since no window can take it.

A batch is one pass over its rows and one write, partitioned by route, so no event can reach both outputs or
neither. The batch's mark (its counts and the new greatest time) is written after the rows and
makes them visible: readers take the batches up to the last mark. A batch that is repeated after a
failure replaces its own folder and is judged by the same earlier mark, so the outcome is that of one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.streaming.bronze import _drain, file_stream

ON_TIME, LATE = "on_time", "late"
MARK = "batch long, max_time timestamp, on_time_rows long, late_rows long"
_ROUTE = "_route"


def _marks(spark: SparkSession, sink: str) -> DataFrame:
    """One row per finished batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/marks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MARK)
    return spark.read.schema(MARK).option("recursiveFileLookup", True).parquet(f"{sink}/marks")


def route_batch(batch: DataFrame, number: int, sink: str, ts: str, delay_seconds: float) -> None:
    """Write one batch by route, then its mark."""
    spark = batch.sparkSession
    seen = _marks(spark, sink).where(F.col("batch") < number).agg(F.max("max_time").alias("t")).first()["t"]
    at = F.col(ts).cast("timestamp")
    if seen is None:
        late = at.isNull()
    else:
        mark = F.lit(seen).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds).cast("decimal(18,6)"))
        late = at.isNull() | (at < mark)
    watched = Observation(f"route-{number}")
    routed = batch.withColumn(_ROUTE, F.when(late, LATE).otherwise(ON_TIME)).observe(
        watched,
        F.max(at).alias("max_time"),
        F.count(F.when(F.col(_ROUTE) == ON_TIME, 1)).alias("on_time_rows"),
        F.count(F.when(F.col(_ROUTE) == LATE, 1)).alias("late_rows"),
    )
    routed.write.mode("overwrite").partitionBy(_ROUTE).parquet(f"{sink}/rows/batch={number}")
    got = watched.get
    newest = max((t for t in (seen, got["max_time"]) if t is not None), default=None)
    row = spark.createDataFrame([(number, newest, got["on_time_rows"], got["late_rows"])], MARK)
    row.coalesce(1).write.mode("overwrite").parquet(f"{sink}/marks/batch={number}")


def split_late(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType | str,
    sink: str,
    checkpoint: str,
    ts: str = "ts",
    delay_seconds: float = 3600,
    path_glob: str | None = None,
    max_files_per_trigger: int | None = None,
) -> dict:
    """Route everything that has landed since the last call, then stop."""
    stream = file_stream(spark, source_dir, schema, path_glob=path_glob, max_files_per_trigger=max_files_per_trigger)
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: route_batch(batch, number, sink, ts, delay_seconds))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return _drain(query)


def routed_rows(spark: SparkSession, sink: str, route: str, schema: T.StructType) -> DataFrame:
    """The rows of one route with their ``batch``, of all batches whose mark is written."""
    if route not in (ON_TIME, LATE):
        raise ValueError(f"route must be {ON_TIME} or {LATE}, not {route!r}")
    last = _marks(spark, sink).agg(F.max("batch")).first()[0]
    if last is None:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField(_ROUTE, T.StringType())])
    rows = spark.read.schema(whole).parquet(f"{sink}/rows")
    return rows.where((F.col(_ROUTE) == route) & (F.col("batch") <= last)).drop(_ROUTE)


def marks(spark: SparkSession, sink: str) -> DataFrame:
    """batch, max_time, on_time_rows, late_rows of every finished batch."""
    return _marks(spark, sink)
