"""Session helper and shared staging folder.

Every job in the package runs with the same SQL settings: UTC session zone (the
test data is TIMESTAMP_NTZ and streaming watermarks need TIMESTAMP), ANSI mode,
and adaptive execution with partition coalescing and skew-join splitting.

Staging output (reload swaps, CSV landing, stream sinks and checkpoints) goes to
the shared folder the cluster names in ``spark.checkpoint.dir``. The setting is
read from the session; a private folder is created only when it is unset, which
is the local-test case.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings applied to any session handed to the package.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def scale_settings(
    input_bytes: int,
    total_cores: int,
    target_partition_bytes: int = 256 * 1024 * 1024,
    max_partitions: int = 200_000,
) -> dict[str, str]:
    """Settings sized to the data, for a cluster run.

    * ``spark.sql.shuffle.partitions`` — enough that a shuffle of the whole
      input gives partitions of about ``target_partition_bytes`` (so a task's
      sort and hash buffers fit in executor memory instead of spilling), never
      fewer than two waves of cores. AQE then coalesces the partitions that
      turn out small, so over-provisioning is cheap and under-provisioning is
      what spills. Capped at ``max_partitions`` (map-status and task
      overhead grow with the count; a shuffle rarely carries the whole input,
      since columns are pruned and aggregates combine before it).
    * file splits of the same size, and AQE's advisory size and skew threshold
      matched to it, so a partition several times the target is split.
    """
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    partitions = min(partitions, max(max_partitions, 2 * total_cores))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def build_session(
    master: str | None = None,
    app_name: str = "lakeaudit",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package's settings.

    ``shuffle_partitions`` should follow the data: about one partition per
    128-256 MB of shuffled data on a cluster (see :func:`scale_settings`,
    passed through ``extra``); about the core count locally.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        **SQL_SETTINGS,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_FALLBACK_ROOT: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    With a local master (tests) it may be unset: a private folder is then created
    once and registered as the checkpoint directory, so later calls agree. Any other
    master raises, since executors could not see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect has no SparkContext
            root = None
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        global _FALLBACK_ROOT
        if _FALLBACK_ROOT is None:
            _FALLBACK_ROOT = tempfile.mkdtemp(prefix="lakeaudit-ckpt-")
        root = _FALLBACK_ROOT
        for setter in (
            lambda: spark.conf.set("spark.checkpoint.dir", root),
            lambda: spark.sparkContext.setCheckpointDir(root),
        ):
            try:  # a session may refuse core settings at runtime
                setter()
            except Exception:
                pass
    return root.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder under the shared staging root."""
    return f"{staging_root(spark)}/lakeaudit-staging/{label}-{uuid.uuid4().hex[:12]}"
