"""Loads: schema and table creation, gated loads, idempotent reloads, count
verification and multi-table runs with per-table fault isolation (S7–S12).

What the reference does and what changes:

* It truncates, then force-copies; a swallowed TRUNCATE error duplicates rows.
  Here a reload writes a new version beside the table, checks it, and only then
  swaps it in (drop + rename). A failure before the swap leaves the old rows
  untouched. ``overwrite_partitions`` replaces only the partitions present in
  the new data.
* It prints row totals and never compares them. Here the source count is
  observed during the write (no second scan of the source) and compared with
  the target's count.
* It counts *exported* rows even when the upload fails. Here the report counts
  rows loaded and rejected, per table, with the error text of a failed table.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeaudit.contracts import Contract
from lakeaudit.operators.gate import tag
from lakeaudit.session import staging_path
from lakeaudit.sources.swap import Version, quoted


# --------------------------------------------------------------------- S7, S8
def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """``CREATE SCHEMA IF NOT EXISTS``. Failure raises (the reference
    carried on after a failed schema creation)."""
    if location:
        spark.sql(
            "CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:s) LOCATION :loc",
            args={"s": name, "loc": location},
        )
    else:
        spark.sql("CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:s)", args={"s": name})


def _table_columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.table(table).schema.fields]


def create_table(
    spark: SparkSession,
    table: str,
    contract: Contract,
    fmt: str = "parquet",
    location: str | None = None,
) -> None:
    """``CREATE TABLE IF NOT EXISTS`` from the contract. If the table exists
    with other columns or types, raise with the difference instead of loading
    into a mismatched table."""
    if spark.catalog.tableExists(table):
        have = _table_columns(spark, table)
        want = [(c.name, contract.schema()[c.name].dataType.simpleString()) for c in contract.columns]
        if have != want:
            raise ValueError(f"table {table} exists with a different schema: have {have}, want {want}")
        return
    parts = [f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:t) ({contract.ddl_columns()}) USING {fmt}"]
    if contract.partition_by:
        parts.append("PARTITIONED BY (" + ", ".join(f"`{c}`" for c in contract.partition_by) + ")")
    args = {"t": table}
    if location:
        parts.append("LOCATION :loc")
        args["loc"] = location
    # NOT NULL is not kept by Parquet tables; strip it so Spark accepts the DDL
    # for every source format, and enforce it in the gate instead.
    spark.sql(" ".join(parts).replace(" NOT NULL", ""), args=args)


# ------------------------------------------------------------------------ S9
def _clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition value together; AQE splits a value holding many rows."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def _write_version(
    spark: SparkSession,
    df: DataFrame,
    table: str,
    partition_by: Sequence[str],
    check: Callable[[int], None] | None,
    like_old: bool,
) -> int:
    """Write ``df`` as a new version of ``table``, check it, swap it in; the rows written."""
    version = Version(spark, table)
    # Counts are observed in the stage that writes (never before a shuffle), so
    # a map stage re-run after a lost executor cannot inflate them.
    obs = Observation(f"version:{table}")
    rows = F.count(F.lit(1)).alias("rows")
    try:
        if like_old:
            spark.sql(f"CREATE TABLE {quoted(version.name)} LIKE {quoted(table)} LOCATION '{version.folder}'")
            _clustered(df.select(*spark.table(table).columns), partition_by).observe(obs, rows).write.insertInto(version.name)
        else:
            writer = _clustered(df, partition_by).observe(obs, rows).write.format("parquet").option("path", version.folder)
            (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(version.name)
        written = int(obs.get["rows"])
        if check:
            check(written)
    except Exception:
        version.discard()
        raise
    version.swap_in()
    return written


def reload_table(
    spark: SparkSession,
    df: DataFrame,
    table: str,
    partition_by: Sequence[str] = (),
    check: Callable[[int], None] | None = None,
) -> int:
    """Idempotent full reload; returns the rows written.

    The rows are written as a new version beside the table (``sources.swap``), counted
    from the write's own metrics and checked (``check(rows)`` raises to abort); only then
    is the version swapped in. Any failure before that leaves the old rows. Afterwards the
    table holds exactly ``df``: partitions absent from it are gone. An existing table keeps
    its columns, types, comments and partitioning; ``partition_by`` must agree with it.
    """
    if not spark.catalog.tableExists(table):
        return _write_version(spark, df, table, partition_by, check, like_old=False)
    have = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if partition_by and list(partition_by) != have:
        raise ValueError(f"table {table} is partitioned by {have}, not by {list(partition_by)}")
    return _write_version(spark, df, table, have, check, like_old=True)


def overwrite_partitions(
    spark: SparkSession, df: DataFrame, table: str, check: Callable[[int], None] | None = None
) -> int:
    """Replace only the partitions that ``df`` has rows of; returns the rows written.

    Rows are staged in the shared folder and checked before any partition is touched;
    each partition is then replaced by dynamic partition overwrite.
    """
    columns = spark.table(table).columns
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if not parts:
        raise ValueError(f"table {table} has no partitions")
    obs = Observation(f"partitions:{table}")
    path = staging_path(spark, "partitions")
    df.select(*columns).observe(obs, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    rows = int(obs.get["rows"])
    if check:
        check(rows)
    staged = spark.read.schema(df.select(*columns).schema).parquet(path)
    # insertInto does not take writer options, so the mode is set on the
    # session for this statement and put back afterwards.
    key = "spark.sql.sources.partitionOverwriteMode"
    previous = spark.conf.get(key, "static")
    spark.conf.set(key, "dynamic")
    try:
        _clustered(staged, parts).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, previous)
    return rows


def replace_table(spark: SparkSession, df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> int:
    """Drop-and-replace; the schema may change. The old table stays until the new
    rows are written; returns the rows written."""
    return _write_version(spark, df, table, partition_by, None, like_old=False)


# ----------------------------------------------------------------------- S3
@dataclass
class GatedResult:
    good_path: str
    rejected_path: str
    rows_read: int
    rows_rejected: int

    @property
    def rows_good(self) -> int:
        return self.rows_read - self.rows_rejected


def gated_load(
    spark: SparkSession,
    df: DataFrame,
    contract: Contract,
    out_path: str | None = None,
) -> GatedResult:
    """S3 at load time, in one pass: the tagged frame is written once,
    partitioned by ``is_rejected``, so good rows land under
    ``is_rejected=false`` and quarantined rows (with reasons and the raw line)
    under ``is_rejected=true``. Counts come from the write's observed metrics.
    """
    out_path = out_path or staging_path(spark, f"gated-{contract.name}")
    obs = Observation(f"gate:{contract.name}")
    tagged = tag(df, contract).observe(
        obs,
        F.count(F.lit(1)).alias("read"),
        F.count(F.when(F.col("is_rejected"), 1)).alias("rejected"),
    )
    # The corrupt-record column must stay referenced until the write, or the
    # reader cannot report malformed lines.
    tagged.write.mode("overwrite").partitionBy("is_rejected").parquet(out_path)
    m = obs.get
    return GatedResult(
        f"{out_path}/is_rejected=false",
        f"{out_path}/is_rejected=true",
        int(m["read"]),
        int(m["rejected"]),
    )


def read_good(spark: SparkSession, result: GatedResult, contract: Contract) -> DataFrame:
    """The good rows of a gated load, with the contract's columns only."""
    if result.rows_good == 0:  # no file was written
        return spark.createDataFrame([], contract.schema())
    return spark.read.parquet(result.good_path).select(*contract.column_names)


# ----------------------------------------------------------------------- S11
def verify_counts(
    spark: SparkSession,
    pairs: Sequence[tuple[str, DataFrame, DataFrame]],
) -> DataFrame:
    """``(table_name, source_rows, target_rows, matches)`` per table.
    Each count is a separate Spark job over the table; the report is built from
    the small list of results."""
    rows = []
    for name, source, target in pairs:
        s = source.count()
        t = target.count()
        rows.append((name, s, t, s == t))
    return spark.createDataFrame(
        rows, "table_name string, source_rows bigint, target_rows bigint, matches boolean"
    )


def run_per_table(fn, items, max_workers: int = 4) -> list:
    """Run ``fn(item)`` for independent tables from a few driver threads, so
    small tables' jobs overlap instead of queueing; results keep input order.
    Each call submits ordinary Spark jobs; the scheduler shares the executors."""
    items = list(items)
    if max_workers <= 1 or len(items) <= 1:
        return [fn(item) for item in items]
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=min(max_workers, len(items))) as pool:
        return list(pool.map(fn, items))


def copy_and_verify(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    target_root: str | None = None,
    max_workers: int = 4,
) -> DataFrame:
    """Load each source frame to Parquet under ``target_root`` and verify: the
    source count is observed during the write, the target count is read back
    from the written files. Tables are independent, so up to ``max_workers``
    of them are copied at the same time."""
    target_root = target_root or staging_path(spark, "verified-load")

    def copy(item):
        name, df = item
        obs = Observation(f"copy:{name}")
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(
            f"{target_root}/{name}"
        )
        source_rows = int(obs.get["rows"])
        target_rows = spark.read.parquet(f"{target_root}/{name}").count()
        return (name, source_rows, target_rows, source_rows == target_rows)

    rows = run_per_table(copy, tables.items(), max_workers)
    return spark.createDataFrame(
        rows, "table_name string, source_rows bigint, target_rows bigint, matches boolean"
    )


# ----------------------------------------------------------------------- S12
@dataclass
class TableLoad:
    """One table of a multi-table load: how to read it and its contract."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    contract: Contract
    partition_by: Sequence[str] = ()


REPORT_SCHEMA = (
    "table_name string, phase string, status string, rows_read bigint, "
    "rows_loaded bigint, rows_rejected bigint, error string"
)


def load_tables(
    spark: SparkSession,
    loads: Sequence[TableLoad],
    schema: str | None = None,
    gate_root: str | None = None,
) -> DataFrame:
    """Load every table; a failure in one (missing file, bad schema,
    everything rejected by the gate) is recorded and the run goes on.

    Per table: read → gate (one pass, good/quarantine written together) →
    staged reload of the good rows → verify the target count equals the good
    count. The report has one row per table with the phase reached.
    """
    gate_root = gate_root or staging_path(spark, "load-run")
    report = []
    for load in loads:
        phase = "read"
        rows_read = rows_loaded = rows_rejected = None
        try:
            df = load.read(spark)
            phase = "gate"
            gated = gated_load(spark, df, load.contract, f"{gate_root}/{load.name}")
            rows_read, rows_rejected = gated.rows_read, gated.rows_rejected
            if rows_read > 0 and gated.rows_good == 0:
                raise ValueError("every row was rejected by the contract gate")
            phase = "load"
            table = f"{schema}.{load.name}" if schema else load.name
            good = read_good(spark, gated, load.contract)

            def _expect(n: int, want=gated.rows_good) -> None:
                if n != want:
                    raise ValueError(f"staged {n} rows, expected {want}")

            rows_loaded = reload_table(spark, good, table, load.partition_by, check=_expect)
            phase = "verify"
            target = spark.table(table).count()
            if target != gated.rows_good:
                raise ValueError(f"target holds {target} rows, expected {gated.rows_good}")
            report.append((load.name, "done", "ok", rows_read, rows_loaded, rows_rejected, None))
        except Exception as exc:  # fault isolation: record and continue
            msg = f"{type(exc).__name__}: {exc}".strip()
            if not str(exc):
                msg = traceback.format_exc(limit=1)
            report.append((load.name, phase, "failed", rows_read, rows_loaded, rows_rejected, msg))
    return spark.createDataFrame(report, REPORT_SCHEMA)
