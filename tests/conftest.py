from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("LAKEAUDIT_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from lakeaudit.session import build_session

    scratch = tempfile.mkdtemp(prefix="lakeaudit-tests-")
    session = build_session(
        "local[*]",
        app_name="lakeaudit-tests",
        shuffle_partitions=8,
        extra={
            # Tests own their checkpoint folder; on a cluster it is set already.
            "spark.checkpoint.dir": f"{scratch}/checkpoint",
            "spark.sql.warehouse.dir": f"{scratch}/warehouse",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def no_views_left(spark):
    """Temporary views go with the module that made them: SHOW TABLES lists them under every schema."""
    yield
    for table in spark.catalog.listTables():
        if table.isTemporary:
            spark.catalog.dropTempView(table.name)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
