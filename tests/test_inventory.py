"""Catalog and file inventory (M1–M7), column profile (M5)."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators.profile import profile
from lakeaudit.plans import catalog, loads
from lakeaudit.sources import files
from tests.conftest import SF_SMALL


def test_catalog_listings(spark, scratch):
    names = [r["name"] for r in catalog.list_catalogs(spark).collect()]
    assert "spark_catalog" in names
    schema = f"inv_{uuid.uuid4().hex[:6]}"
    loads.create_schema(spark, schema, os.path.join(scratch, schema))
    spark.range(3).write.format("parquet").saveAsTable(f"{schema}.orders")
    assert schema in [r["name"] for r in catalog.list_schemas(spark, "spark_catalog").collect()]
    assert catalog.list_schemas(spark, "nonexistent_catalog").count() == 0
    tables = catalog.list_tables(spark, "spark_catalog", schema).collect()
    assert [(t["name"], t["format"]) for t in tables] == [("orders", "PARQUET")]
    assert catalog.list_tables(spark, "spark_catalog", "no_such_schema").count() == 0
    assert "profile" not in catalog.describe_table(spark, f"{schema}.orders")
    detail = catalog.describe_table(spark, f"{schema}.orders", with_profile=True, exact_distinct=True)
    assert detail["row_count"] == 3 and detail["num_files"] >= 1 and detail["size_bytes"] > 0
    assert detail["updated_at"] is not None
    assert [c["name"] for c in detail["columns"]] == ["id"]
    assert detail["profile"][0]["distinct_count"] == 3
    with pytest.raises(ValueError, match="not found"):
        catalog.describe_table(spark, f"{schema}.some_unknown_table")


def _tree(root):
    for rel, size in [("a.txt", 5), ("sub/b.bin", 7), ("sub/deeper/c.bin", 11)]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(b"x" * size)


def test_list_files(spark, scratch):
    root = os.path.join(scratch, "tree")
    _tree(root)
    got = {r["path"]: (r["is_dir"], r["file_size"], r["n_files"]) for r in files.list_files(spark, root).collect()}
    assert got == {f"{root}/a.txt": (False, 5, 1), f"{root}/sub": (True, 0, 2)}
    totals = {r["path"]: r["total_bytes"] for r in files.list_files(spark, root).collect()}
    assert totals == {f"{root}/a.txt": 5, f"{root}/sub": 18}
    # trailing slash ignored
    assert files.list_files(spark, root + "/").count() == 2
    nested = {r["path"] for r in files.list_files(spark, f"{root}/sub").collect()}
    assert nested == {f"{root}/sub/b.bin", f"{root}/sub/deeper"}
    assert files.list_files(spark, os.path.join(scratch, "missing")).count() == 0


def test_file_info(spark, scratch):
    root = os.path.join(scratch, "tree")
    _tree(root)
    info = files.file_info(spark, f"{root}/sub/b.bin").collect()
    assert len(info) == 1 and info[0]["is_dir"] is False and info[0]["file_size"] == 7
    assert files.file_info(spark, f"{root}/sub/").first()["is_dir"] is True
    assert files.file_info(spark, f"{root}/nope.parquet").count() == 0


def test_listing_prunes_file_content(spark, capsys):
    files.all_files(spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    read_schema = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert read_schema and all("content" not in line for line in read_schema)


def test_profile_exact_and_approx(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    exact = {r["column_name"]: r for r in profile(df).collect()}
    assert exact["o_orderkey"]["distinct_count"] == df.select("o_orderkey").distinct().count()
    assert exact["o_orderstatus"]["min_value"] == "F" and exact["o_orderstatus"]["max_value"] == "P"
    approx = {r["column_name"]: r for r in profile(df, exact=False).collect()}
    n = exact["o_custkey"]["distinct_count"]
    assert abs(approx["o_custkey"]["distinct_count"] - n) <= max(3, 0.1 * n)
    withnull = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    p = {r["column_name"]: r for r in profile(withnull).collect()}
    assert p["b"]["null_count"] == 1 and p["a"]["null_count"] == 0
    assert profile(withnull.filter(F.lit(False))).first()["row_count"] == 0
