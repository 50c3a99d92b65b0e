"""Session helpers: data-sized settings and the shared staging folder."""

from __future__ import annotations

from lakeaudit.session import scale_settings, staging_path, staging_root


def test_scale_settings_follow_the_data():
    small = scale_settings(50 * 1024**2, total_cores=8)
    assert small["spark.sql.shuffle.partitions"] == "16"  # two waves of cores
    big = scale_settings(10 * 1024**4, total_cores=4000)
    assert big["spark.sql.shuffle.partitions"] == str(10 * 1024**4 // (256 * 1024**2))
    huge = scale_settings(100 * 1024**4, total_cores=8000)
    assert huge["spark.sql.shuffle.partitions"] == "200000"
    assert int(big["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) < int(big["spark.sql.files.maxPartitionBytes"])


def test_staging_under_checkpoint_dir(spark):
    root = staging_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    a, b = staging_path(spark, "x"), staging_path(spark, "x")
    assert a != b and a.startswith(root + "/lakeaudit-staging/x-")
