"""File-level load ledger (S2, S9): repeat a load, load new files only, or force all of them.

``copy_into`` loads a folder into a target folder that remembers its files:

* ``files/load=n``: the manifest of load n, one row per file (path, length, modified, rows, digest);
* ``rows/load=n``: the rows that load n has read, with the file they came from.

The listing is anti-joined with the manifest before anything is read, so files whose path,
length and modification time are known cost nothing. A file that was changed in place is read again. With
``force`` every listed file is read again. Either way a file's newest load replaces its earlier
rows, so no sequence of loads doubles a row.

A load writes its rows, reads them back once to count and digest them per file, and then writes its manifest.
The manifest is what makes the load visible: a load that failed before that leaves a folder no reader
looks at, and the next load takes a new number. Readers take, for every path, the rows of its last load.

The digest is the sum of the rows' 64-bit hashes: equal for equal rows in any order, so ``changed_files``
tells which files' content differs between two loads. A file that no longer exists keeps its rows. Files
without bytes are not listed by Spark and so are not in the manifest.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = "_source_file"
LISTED = "path string, length long, modified timestamp"
MANIFEST = f"{LISTED}, rows long, digest decimal(38,0), load long"
_GLOB = re.compile(r"([\\{}\[\]*?])")


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the ``load=n`` folders in ``folder``."""
    fs, path = _folder(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("load=")) for n in names if n.startswith("load="))


def source_files(spark: SparkSession, source: str, pattern: str | None = None) -> DataFrame:
    """path, length, modified (and plain, the path to open) of the data files below ``source``; contents are not read."""
    fs, path = _folder(spark, source)
    if not fs.exists(path):
        return spark.createDataFrame([], f"{LISTED}, plain string")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # The path is written as the rows' own file column has it (encoded); "plain" is the one to open.
    return reader.load(source).select(
        F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("path").alias("plain")
    )


def manifest(spark: SparkSession, target: str, all_loads: bool = False) -> DataFrame:
    """The files of ``target``: the newest entry of every path, or with ``all_loads`` the entries of every load."""
    if not _numbers(spark, f"{target}/files"):
        return spark.createDataFrame([], MANIFEST)
    entries = spark.read.schema(MANIFEST).parquet(f"{target}/files")
    if all_loads:
        return entries
    rest = [c for c in entries.columns if c not in ("path", "load")]
    newest = entries.groupBy("path").agg(F.max(F.struct("load", *rest)).alias("of"))
    return newest.select("path", *[f"of.{c}" for c in rest], "of.load")


def copy_into(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    pattern: str | None = None,
    force: bool = False,
) -> dict[str, int]:
    """Load the files of ``source`` that ``target`` does not know. Returns files_seen, files_loaded, rows_loaded and load (0: nothing to do)."""
    listed = source_files(spark, source, pattern).persist()
    try:
        fresh = listed if force else listed.join(manifest(spark, target), ["path", "length", "modified"], "left_anti")
        paths = [_GLOB.sub(r"\\\1", r["plain"]) for r in fresh.select("plain").collect()]  # names of new files only; Spark's reader holds them on the driver as well
        report = {"files_seen": listed.count(), "files_loaded": len(paths), "rows_loaded": 0, "load": 0}
        if not paths:
            return report
        number = max([0, *_numbers(spark, f"{target}/rows"), *_numbers(spark, f"{target}/files")]) + 1
        rows = spark.read.format(fmt).schema(schema).options(**dict(options or {})).load(paths)
        rows.select("*", F.col("_metadata.file_path").alias(FILE)).write.mode("errorifexists").parquet(f"{target}/rows/load={number}")
        written = spark.read.schema(T.StructType([*schema.fields, T.StructField(FILE, T.StringType())])).parquet(f"{target}/rows/load={number}")
        hashed = F.xxhash64(*[F.col(c) for c in schema.fieldNames()]).cast("decimal(20,0)")
        counted = written.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows"), F.sum(hashed).cast("decimal(38,0)").alias("digest"))
        entries = fresh.join(counted, fresh["path"] == counted[FILE], "left").select(
            "path", "length", "modified", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("digest", F.lit(0).cast("decimal(38,0)")).alias("digest")
        )
        entries.coalesce(1).write.mode("errorifexists").parquet(f"{target}/files/load={number}")
        report["rows_loaded"] = spark.read.parquet(f"{target}/files/load={number}").agg(F.sum("rows")).first()[0]
        report["load"] = number
        return report
    finally:
        listed.unpersist()


def loaded(spark: SparkSession, target: str, schema: T.StructType, with_file: bool = False) -> DataFrame:
    """The rows of ``target``: of every file those of its newest load."""
    wide = T.StructType([*schema.fields, T.StructField(FILE, T.StringType()), T.StructField("load", T.LongType())])
    done = _numbers(spark, f"{target}/files")
    names = [*schema.fieldNames(), *([FILE] if with_file else [])]
    if not done:
        return spark.createDataFrame([], wide).select(*names)
    rows = spark.read.schema(wide).parquet(f"{target}/rows").where(F.col("load").isin(done))
    live = manifest(spark, target).select(F.col("path").alias(FILE), "load")
    return rows.join(live, [FILE, "load"], "left_semi").select(*names)


def changed_files(spark: SparkSession, target: str) -> DataFrame:
    """path, load, rows, digest of every entry whose rows differ from those of the path's load before."""
    from pyspark.sql import Window

    entries = manifest(spark, target, all_loads=True)
    before = Window.partitionBy("path").orderBy("load")
    seen = entries.withColumn("_la_was", F.lag(F.struct("rows", "digest")).over(before))
    return seen.where(F.col("_la_was").isNotNull() & (F.col("_la_was") != F.struct("rows", "digest"))).select("path", "load", "rows", "digest")
