"""Schema/table creation, idempotent reloads, count verification and
multi-table loads with fault isolation (S4, S6–S12)."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lakeaudit.contracts import AUDIT_TABLES, CUSTOMERS, SILVER_ORDERS, contract_from_schema
from lakeaudit.plans import loads
from lakeaudit.sources import parquet


@pytest.fixture()
def schema(spark, scratch):
    name = f"t_{uuid.uuid4().hex[:8]}"
    loads.create_schema(spark, name, os.path.join(scratch, name))
    return name


def _customers(spark, n=5):
    rows = [(f"c{i}", "US", "tier1", "low", f"2025-01-0{1 + i % 9}", None) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id string, registration_country string, kyc_tier string, "
                                       "risk_level string, registration_date string, created_at timestamp"
                                 ).withColumn("registration_date", F.to_date("registration_date"))


def test_create_schema_and_audit_tables(spark, schema):
    for c in AUDIT_TABLES:
        loads.create_table(spark, f"{schema}.{c.name}", c)
        loads.create_table(spark, f"{schema}.{c.name}", c)  # IF NOT EXISTS: second call is a no-op
        assert spark.table(f"{schema}.{c.name}").columns == c.column_names


def test_create_table_schema_mismatch_raises(spark, schema):
    spark.sql(f"CREATE TABLE {schema}.customers (customer_id STRING) USING parquet")
    with pytest.raises(ValueError, match="different schema"):
        loads.create_table(spark, f"{schema}.customers", CUSTOMERS)


def test_reload_twice_is_idempotent(spark, schema):
    table = f"{schema}.customers"
    df = _customers(spark, 5)
    assert loads.reload_table(spark, df, table) == 5
    assert loads.reload_table(spark, df, table) == 5
    assert spark.table(table).count() == 5


def test_failed_reload_keeps_old_rows(spark, schema):
    table = f"{schema}.customers"
    loads.reload_table(spark, _customers(spark, 5), table)

    def reject(n):
        raise ValueError("check failed")

    with pytest.raises(ValueError):
        loads.reload_table(spark, _customers(spark, 3), table, check=reject)
    assert spark.table(table).count() == 5
    leftovers = [t.name for t in spark.catalog.listTables(schema) if "__staging" in t.name]
    assert leftovers == []


def _days(spark):
    return spark.createDataFrame(
        [(1, 1, 1, "2025-01-01", "shipped", 1.0, "2025-01-01 00:00:00"),
         (2, 1, 1, "2025-01-02", "shipped", 2.0, "2025-01-02 00:00:00")],
        "order_id bigint, user_id bigint, product_id bigint, order_date string, status string, "
        "amount double, updated_at string",
    ).select(
        "order_id", "user_id", "product_id", F.to_date("order_date").alias("order_date"), "status", "amount",
        F.to_timestamp("updated_at").alias("updated_at"),
    )


def _amounts(spark, table):
    return {r["order_id"]: r["amount"] for r in spark.table(table).collect()}


def test_partitioned_reload_holds_exactly_the_new_rows(spark, schema):
    table = f"{schema}.orders"
    loads.create_table(spark, table, SILVER_ORDERS)
    base = _days(spark)
    comments = [c.description for c in spark.catalog.listColumns(table)]
    assert loads.reload_table(spark, base, table, partition_by=["order_date"]) == 2
    assert loads.reload_table(spark, base, table, partition_by=["order_date"]) == 2
    assert _amounts(spark, table) == {1: 1.0, 2: 2.0}
    assert spark.table(table).where("order_date = DATE '2025-01-01'").count() == 1
    # a day absent from the new load is gone
    day2 = base.filter(F.col("order_id") == 2).withColumn("amount", F.lit(9.0))
    loads.reload_table(spark, day2, table, partition_by=["order_date"])
    assert _amounts(spark, table) == {2: 9.0}
    assert [c.description for c in spark.catalog.listColumns(table)] == comments
    with pytest.raises(ValueError, match="partitioned by"):
        loads.reload_table(spark, base, table, partition_by=["status"])


def test_first_partitioned_load_reads_back(spark, schema):
    table = f"{schema}.fresh"
    assert loads.reload_table(spark, _days(spark), table, partition_by=["order_date"]) == 2
    assert _amounts(spark, table) == {1: 1.0, 2: 2.0}


def test_failed_partitioned_reload_keeps_old_rows(spark, schema):
    table = f"{schema}.kept"
    loads.reload_table(spark, _days(spark), table, partition_by=["order_date"])

    def reject(n):
        raise ValueError("check failed")

    changed = _days(spark).withColumn("amount", F.lit(7.0))
    with pytest.raises(ValueError):
        loads.reload_table(spark, changed, table, partition_by=["order_date"], check=reject)
    with pytest.raises(ValueError):
        loads.overwrite_partitions(spark, changed, table, check=reject)
    assert _amounts(spark, table) == {1: 1.0, 2: 2.0}
    # replacing one day leaves the other
    loads.overwrite_partitions(spark, changed.where("order_id = 2"), table)
    assert _amounts(spark, table) == {1: 1.0, 2: 7.0}


def test_replace_with_a_missing_source_keeps_the_old_table(spark, schema, scratch):
    table = f"{schema}.old"
    loads.replace_table(spark, spark.range(3), table)
    with pytest.raises(Exception):
        parquet.create_table_from_parquet(spark, table, os.path.join(scratch, "absent"), replace=True)
    boom = spark.range(4).withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.lit(1)))
    with pytest.raises(Exception):
        loads.replace_table(spark, boom, table)
    assert spark.table(table).count() == 3
    folder = spark.catalog.getDatabase(schema).locationUri.removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.startswith("old__v_")]) == 1


def test_ctas_and_drift(spark, schema):
    df = spark.range(3).withColumn("extra", F.lit("x"))
    path = os.path.join(spark.conf.get("spark.checkpoint.dir"), f"p-{uuid.uuid4().hex[:6]}")
    parquet.write_parquet(df, path)
    t = parquet.create_table_from_parquet(spark, f"{schema}.ranged", path)
    assert t.count() == 3
    t2 = parquet.create_table_from_parquet(spark, f"{schema}.ranged", path, replace=True)
    assert t2.count() == 3
    contract = contract_from_schema("ranged", spark.range(1).withColumn("missing", F.lit(1)).schema)
    drift = {(r["column_name"], r["change"]) for r in parquet.schema_drift(spark, df.schema, contract).collect()}
    assert drift == {("missing", "missing"), ("extra", "extra")}


def test_verify_counts(spark):
    a = spark.range(10)
    report = loads.verify_counts(spark, [("a", a, a), ("b", a, a.limit(3))]).collect()
    got = {r["table_name"]: (r["source_rows"], r["target_rows"], r["matches"]) for r in report}
    assert got == {"a": (10, 10, True), "b": (10, 3, False)}


def test_multi_table_load_isolates_failures(spark, schema, scratch):
    good = loads.TableLoad("customers", lambda s: _customers(s, 4), CUSTOMERS)

    def missing(s):
        return s.read.parquet(os.path.join(scratch, "does-not-exist"))

    absent = loads.TableLoad("transactions", missing, contract_from_schema("transactions", _customers(spark).schema))

    def all_bad(s):
        return _customers(s, 3).withColumn("kyc_tier", F.lit(None).cast("string"))

    rejected = loads.TableLoad("disclosures", all_bad, CUSTOMERS)
    report = {r["table_name"]: r for r in loads.load_tables(spark, [absent, rejected, good], schema=schema).collect()}
    assert report["customers"]["status"] == "ok"
    assert report["customers"]["rows_loaded"] == 4
    assert report["transactions"]["status"] == "failed" and report["transactions"]["phase"] == "read"
    assert report["disclosures"]["status"] == "failed" and report["disclosures"]["phase"] == "gate"
    assert report["disclosures"]["rows_rejected"] == 3
    assert spark.table(f"{schema}.customers").count() == 4


def test_gated_load_counts(spark, scratch):
    df = _customers(spark, 4).union(_customers(spark, 2).withColumn("risk_level", F.lit(None).cast("string")))
    res = loads.gated_load(spark, df, CUSTOMERS, os.path.join(scratch, "gated"))
    assert (res.rows_read, res.rows_rejected, res.rows_good) == (6, 2, 4)
    assert loads.read_good(spark, res, CUSTOMERS).count() == 4
    bad = spark.read.parquet(res.rejected_path)
    assert bad.count() == 2
    assert {tuple(r["reasons"]) for r in bad.collect()} == {("null:risk_level",)}


def test_partitioned_writers(spark, scratch):
    from lakeaudit.operators import medallion

    df = spark.createDataFrame(
        [(1, 1, 1, "2025-01-01", "Shipped ", 1.0, "2025-01-01 00:00:00"),
         (1, 1, 1, "2025-01-01", "delivered", 1.0, "2025-01-02 00:00:00"),
         (2, 1, 1, "2025-01-02", "lost", 2.0, "2025-01-02 00:00:00")],
        "order_id bigint, user_id bigint, product_id bigint, order_date string, status string, "
        "amount double, updated_at string",
    ).select("order_id", "user_id", "product_id", F.to_date("order_date").alias("order_date"), "status",
             "amount", F.to_timestamp("updated_at").alias("updated_at"))
    good, bad = medallion.silver_orders(df)
    assert [(r["order_id"], r["status"]) for r in good.collect()] == [(1, "delivered")]
    assert [r["order_id"] for r in bad.collect()] == [2]
    out = os.path.join(scratch, "silver")
    medallion.write_silver(good, out)
    medallion.write_silver(good, out)
    assert spark.read.parquet(out).count() == 1
    assert os.path.isdir(os.path.join(out, "order_date=2025-01-01"))
    out2 = os.path.join(scratch, "contract")
    parquet.write_contract_parquet(df, out2, SILVER_ORDERS)
    parts = sorted(d for d in os.listdir(out2) if d.startswith("order_date="))
    assert parts == ["order_date=2025-01-01", "order_date=2025-01-02"]


def test_partitioned_write_splits_hot_value(spark, scratch):
    """A partition value holding half the rows is written by several tasks."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("p"),
        F.col("id"),
        F.sha2(F.col("id").cast("string"), 256).alias("pad"),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    previous = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        out = os.path.join(scratch, "skewed")
        parquet.write_parquet(df, out, partition_by=["p"])
    finally:
        spark.conf.set(key, previous)
    hot_files = [f for f in os.listdir(os.path.join(out, "p=hot")) if f.endswith(".parquet")]
    assert len(hot_files) > 1
    assert spark.read.parquet(out).count() == 200_000


def test_reload_failing_midway_keeps_old_rows(spark, schema):
    """A write that fails part-way (one bad row raises inside the job) leaves
    the previous rows in place."""
    table = f"{schema}.customers"
    loads.reload_table(spark, _customers(spark, 5), table)
    bad = _customers(spark, 9).withColumn(
        "kyc_tier",
        F.when(F.col("customer_id") == "c7", F.raise_error(F.lit("boom"))).otherwise(F.col("kyc_tier")),
    )
    with pytest.raises(Exception):
        loads.reload_table(spark, bad, table)
    assert spark.table(table).count() == 5
    assert loads.reload_table(spark, _customers(spark, 6), table) == 6


def test_contract_from_schema_keeps_complex_types(spark, schema):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    contract = contract_from_schema("embeddings", emb.schema)
    assert contract.schema() == emb.schema
    report = loads.load_tables(spark, [loads.TableLoad("embeddings", lambda s: emb, contract)], schema=schema).first()
    assert report["status"] == "ok" and report["rows_loaded"] == emb.count()
    assert spark.table(f"{schema}.embeddings").schema["embedding"].dataType == emb.schema["embedding"].dataType


def test_replace_table_changes_schema(spark, schema):
    table = f"{schema}.replaced"
    loads.replace_table(spark, spark.range(3), table)
    loads.replace_table(spark, spark.range(2).withColumn("extra", F.lit("x")), table)
    t = spark.table(table)
    assert t.count() == 2 and t.columns == ["id", "extra"]
