"""Run ledger for parameterised load steps.

The reference triggers jobs on a remote scheduler and reads their state back.
No scheduler is built here. What remains is the user-level data work: a step
is a parameterised SQL statement whose result is written to a path or table, and every
run appends life-cycle rows to a ledger (Parquet in the shared staging folder).
Run state and job listings are queries over that ledger.

Parameters arrive as JSON text, must be a JSON object, and bind as named SQL
markers (``:name``) — never spliced into the statement. Invalid JSON returns
``{"error": …}`` rather than raising, as the reference's tool does.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.operators.segmented import latest_per_key

LEDGER_SCHEMA = (
    "run_id bigint, job_id bigint, job_name string, params string, state string, "
    "result_state string, event_ts timestamp, event_seq int, rows_written bigint, "
    "output_path string, error string"
)


def parse_params(params) -> tuple[dict | None, str | None]:
    """``(dict, None)`` or ``(None, error)``. ``None``/empty → ``{}``."""
    if params is None or params == "":
        return {}, None
    if isinstance(params, dict):
        return params, None
    try:
        value = json.loads(params)
    except json.JSONDecodeError as e:
        return None, f"params must be valid JSON: {e}"
    if not isinstance(value, dict):
        return None, "params must be a JSON object"
    return value, None


def _append(spark: SparkSession, ledger_path: str, row: tuple) -> None:
    spark.createDataFrame([row], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(ledger_path)


def run_job(
    spark: SparkSession,
    ledger_path: str,
    job_id: int,
    statement: str,
    params=None,
    output_path: str | None = None,
    job_name: str = "",
    run_id: int | None = None,
    output_table: str | None = None,
) -> dict:
    """Run one parameterised step and record it. The result goes to
    ``output_path`` (Parquet) or ``output_table`` (a catalog table, replaced).
    Returns ``{run_id, job_id, params, state, rows_written, output_path}``."""
    parsed, error = parse_params(params)
    if error:
        return {"error": error}
    run_id = run_id if run_id is not None else uuid.uuid4().int % (1 << 53)
    ptext = json.dumps(parsed, sort_keys=True)
    now = dt.datetime.now(dt.timezone.utc)
    target = output_table or output_path
    _append(spark, ledger_path, (run_id, job_id, job_name, ptext, "RUNNING", None, now, 0, None, target, None))
    rows = None
    try:
        df = spark.sql(statement, args=parsed or None)
        if output_path or output_table:
            obs = Observation(f"run:{run_id}")
            writer = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
            if output_table:
                writer.format("parquet").saveAsTable(output_table)
            else:
                writer.parquet(output_path)
            rows = int(obs.get["rows"])
        state, result, err = "TERMINATED", "SUCCESS", None
    except Exception as exc:
        state, result, err = "TERMINATED", "FAILED", f"{type(exc).__name__}: {exc}"
    end = dt.datetime.now(dt.timezone.utc)
    _append(spark, ledger_path, (run_id, job_id, job_name, ptext, state, result, end, 1, rows, target, err))
    return {
        "run_id": run_id, "job_id": job_id, "params": parsed, "state": result,
        "rows_written": rows, "output_path": target, "error": err,
    }


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":  # nothing recorded yet
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def job_runs(ledger: DataFrame) -> DataFrame:
    """P2 over all runs: latest life-cycle row per run plus its start time and
    duration. ``end_time`` is NULL while a run is still RUNNING."""
    latest = latest_per_key(ledger, "run_id", ["event_ts", "event_seq"])
    starts = ledger.groupBy("run_id").agg(F.min("event_ts").alias("start_time"))
    out = latest.join(starts, "run_id")
    finished = F.col("state") != F.lit("RUNNING")
    return out.select(
        "run_id", "job_id", "job_name", "params",
        F.col("state").alias("life_cycle_state"), "result_state",
        "start_time",
        F.when(finished, F.col("event_ts")).alias("end_time"),
        F.when(finished, F.col("event_ts").cast("double") - F.col("start_time").cast("double")).alias(
            "duration_seconds"
        ),
        "rows_written", "output_path", "error",
    )


def get_job_run(spark: SparkSession, ledger_path: str, run_id: int) -> DataFrame:
    """One run's state; an unknown run gives no row."""
    return job_runs(read_ledger(spark, ledger_path)).filter(F.col("run_id") == F.lit(run_id))


def list_jobs(spark: SparkSession, ledger_path: str, limit: int = 25) -> DataFrame:
    """P3 over the ledger at ``ledger_path``; see ``first_jobs``."""
    return first_jobs(read_ledger(spark, ledger_path), limit)


def first_jobs(ledger: DataFrame, limit: int = 25) -> DataFrame:
    """Jobs seen in the ledger, ordered by job id, first ``limit``; ``more_jobs`` tells
    whether others follow (one row beyond the limit is looked at)."""
    per_job = job_runs(ledger).groupBy("job_id").agg(
        F.max("job_name").alias("name"),
        F.count(F.lit(1)).cast("bigint").alias("runs"),
        F.max("start_time").alias("last_run_at"),
    )
    head = per_job.orderBy("job_id").limit(limit + 1)  # so few rows that one window task holds them
    seen = Window.orderBy("job_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = head.select(
        "*",
        F.row_number().over(Window.orderBy("job_id")).alias("_at"),
        (F.count(F.lit(1)).over(seen) > limit).alias("more_jobs"),
    )
    return numbered.where(F.col("_at") <= limit).drop("_at")
