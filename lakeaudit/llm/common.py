"""Helpers shared by the operators: the shared folder, written cut points and columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local master, whose driver and executors share one disk, may leave the
    setting unset; a folder of its own is then set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The rows outlive a lost executor and the plan above starts from a scan.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers started from a checkout import this package as the driver does."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: What Python workers keep between their tasks, by operator: a worker runs the tasks of one operator after another.
_CACHES: dict[str, Callable[[], None]] = {}


def keep_cache(operator: str, clear: Callable[[], None]) -> None:
    """Name the cache that ``operator`` keeps in a worker, and how it is dropped."""
    _CACHES[operator] = clear


def drop_caches(operator: str) -> None:
    """Called as a task of ``operator`` starts: what other operators have kept in this worker goes."""
    for name, clear in _CACHES.items():
        if name != operator:
            clear()


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """Lower-cased maximal runs of letters, marks, digits and underscores."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+")
    return F.filter(words, lambda w: w != "")


def shingle_array(words: Column, n: int = 5) -> Column:
    """64-bit hashes of every run of ``n`` words, in order; empty below ``n`` words.

    Each word is hashed once; a run is the hash of its ``n`` word hashes.
    """

    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - F.lit(n - 1)
        return F.when(
            last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, n)))
        ).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), runs)
