"""File inventory (M6, M7) with the ``binaryFile`` source.

Only ``path``, ``length`` and ``modificationTime`` are selected, so the file
contents are pruned from the scan (``ReadSchema`` has no ``content``); the
listing itself is distributed by Spark's file index.

``list_files(root)`` returns the direct children of ``root``: files directly in
it, and one row per sub-directory that contains files. Directory rows have
``file_size`` 0 (as in the reference's listing) and carry the file count and
total bytes beneath them, computed by a group-by on the child name. Directories that hold
no files at any depth are invisible to this source; that is a documented limit.
A missing root gives an empty frame, as the reference's listing does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

def normalise(path: str) -> str:
    """Trailing ``/`` ignored; the root stays ``/``."""
    return path.rstrip("/") or "/"


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` at any depth: ``(path, length, modified_at)``."""
    try:
        df = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(normalise(root))
        )
    except AnalysisException:
        return spark.createDataFrame([], "path string, length bigint, modified_at timestamp")
    return df.select("path", "length", F.col("modificationTime").alias("modified_at"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """M6: direct children of ``root``."""
    root = normalise(root)
    files = all_files(spark, root)
    # Paths come back fully qualified (``file:/…``); compare on the part after the root.
    rel = F.regexp_extract(F.col("path"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(.*)$", 1)
    prefix = root if root != "/" else ""
    tail = F.expr(f"substring(_rel, {len(prefix) + 2})")
    staged = files.withColumn("_rel", rel).filter(F.col("_rel").startswith(prefix + "/"))
    staged = staged.withColumn("_tail", tail)
    child = F.split(F.col("_tail"), "/").getItem(0)
    is_dir = F.instr(F.col("_tail"), "/") > 0
    return (
        staged.groupBy(child.alias("name"), is_dir.alias("is_dir"))
        .agg(
            F.sum(F.when(~is_dir, F.col("length")).otherwise(F.lit(0))).cast("bigint").alias("file_size"),
            F.count(F.lit(1)).cast("bigint").alias("n_files"),
            F.sum("length").cast("bigint").alias("total_bytes"),
            F.max("modified_at").alias("modified_at"),
        )
        .select(
            F.concat(F.lit(prefix + "/"), F.col("name")).alias("path"),
            "name",
            "is_dir",
            F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("file_size")).cast("bigint").alias("file_size"),
            "n_files",
            "total_bytes",
            "modified_at",
        )
    )


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """M7: the entry for one exact path (file or directory), or no row."""
    path = normalise(path)
    parent = path.rsplit("/", 1)[0] or "/"
    return list_files(spark, parent).filter(F.col("path") == path)
