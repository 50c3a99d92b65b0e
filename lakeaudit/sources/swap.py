"""New versions of catalog tables: written beside the old one, then swapped in.

A version is a staging table over a folder of its own below the schema's location
(``<table>__v_<id>``). It is filled and checked while the old table stays readable.
``swap_in`` then points the old table at the version's folder, in one catalog call, so a reader
finds the old rows or the new ones and never a missing table. That holds for tables without
partitions whose columns stay; partitions have locations of their own and a table's columns belong to its
entry, so in these cases the old table is dropped and the staging table renamed, two calls
between which the table is missing. The rename moves no data, since the version has its own location.
A version that fails is discarded with its folder and the old table is untouched.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def quoted(table: str) -> str:
    return ".".join("`" + part.strip("`") + "`" for part in table.split("."))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Version:
    """One new version of ``table``; nothing is created before the caller writes it."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table
        database, _, name = table.rpartition(".")
        suffix = uuid.uuid4().hex[:8]
        self.name = f"{table}__staging_{suffix}"
        self._folders = re.compile(re.escape(name.strip("`")) + r"__v_[0-9a-f]{8}")
        location = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
        self.folder = f"{location.rstrip('/')}/{name.strip('`')}__v_{suffix}"

    def _location(self, table: str) -> str | None:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").where("col_name = 'Location'").head(1)
        return rows[0]["data_type"] if rows else None

    def discard(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(self.name)}")
        remove_folder(self.spark, self.folder)

    def _columns(self, table: str) -> list[tuple]:
        return [(c.name, c.dataType, c.isPartition) for c in self.spark.catalog.listColumns(table)]

    def swap_in(self) -> None:
        """The version becomes the table. The old rows' folder goes if it was an earlier version's or the
        catalog's own; a folder that a user named for the table is left as it is."""
        old = self._location(self.table) if self.spark.catalog.tableExists(self.table) else None
        if old and (columns := self._columns(self.table)) == self._columns(self.name) and not any(c[2] for c in columns):
            managed = self.spark.catalog.getTable(self.table).tableType == "MANAGED"
            self.spark.sql(f"ALTER TABLE {quoted(self.table)} SET LOCATION '{self.folder}'")
            self.spark.catalog.refreshTable(self.table)
            self.spark.sql(f"DROP TABLE {quoted(self.name)}")  # external: its folder stays
            if managed or self._folders.fullmatch(old.rstrip("/").rpartition("/")[2]):
                remove_folder(self.spark, old)
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(self.table)}")
        self.spark.sql(f"ALTER TABLE {quoted(self.name)} RENAME TO {quoted(self.table)}")
        if old and self._folders.fullmatch(old.rstrip("/").rpartition("/")[2]):
            remove_folder(self.spark, old)
