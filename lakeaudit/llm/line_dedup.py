"""Line deduplication over levelled sorted runs of line hashes (built-in functions only).

``LineRuns`` keeps, per line key, the number of documents seen so far, as runs in the
shared folder: Parquet tables sorted by the key's 128-bit hash. A new batch counts its
own keys, drops those that the runs already hold as frequent (an anti-join, since their
fate is settled) and is added as a run of level 0; ``fanout`` runs of a level are merged
into one run of the next level, so a batch rewrites its keys a logarithmic number of times.

``drop_frequent_lines`` feeds the documents through the runs in batches and then removes
every line whose key is in at least ``min_docs`` documents, in every document. Texts are
moved once, to meet the places of their dropped lines; a line that a third of all
documents share is a key of partial counts and of one join that adaptive execution splits.

Defined cases: null and empty texts are one empty line; lines whose key has under
``min_chars`` code points always stay; every row is a document of its own, whatever its doc_id
(null, or one that other rows have too); a document may lose all its
lines and is returned with the empty text; empty tables give no rows; other columns are
returned as they are, whatever their names, unless they are named like the added columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import bind, cut, shared_folder, text_or_empty

# The contract's white space and case folding.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MIN_CHARS, BATCHES, FANOUT = 10, 1, 4, 3


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() folds more than A-Z, but not in ASCII texts, where it is far quicker.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Runs of (h1, h2, n_docs), by level, in a folder of their own."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder, self.levels, self.written = shared_folder(spark, "line-runs"), [], 0

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}/run-{self.written:06d}"
        self.written += 1
        while len(self.levels) <= level:
            self.levels.append([])
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        counts.select("h1", "h2", "n_docs").repartitionByRange(parts, "h1").sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._write(merged, level + 1)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*paths)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def add(self, lines: DataFrame) -> None:
        """Count a batch of (row, h1, h2); no document may be in two batches."""
        counts = lines.select("row", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        runs = [p for level in self.levels for p in level]
        if runs:
            settled = self._read(runs).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            counts = counts.join(settled, ["h1", "h2"], "left_anti")
        self._write(counts, 0)

    def frequent(self) -> DataFrame:
        """The keys (h1, h2) of at least ``min_docs`` documents over all batches."""
        runs = [p for level in self.levels for p in level]
        return self._merged(runs).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` cut, and n_lines, n_dropped."""
    spark = docs.sparkSession
    # The number is given before the lines are made, and fixed when they are written.
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).select(
        "row",
        F.xxhash64("doc_id", "text").alias("r1"),
        F.xxhash64(F.lit(7), "doc_id", "text").alias("r2"),
        F.posexplode(F.transform(F.split(text_or_empty("text"), "\n", -1), line_key)).alias("pos", "key"),
    ).where((F.char_length("key") >= min_chars) & (F.length("key") > 0))
    lines = rows.select(
        "row", "r1", "r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
        F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"),
    )
    lines = cut(lines, "lines")
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    frequent = cut(runs.frequent(), "frequent-lines")
    dropped = (
        lines.join(frequent, ["h1", "h2"])
        .groupBy("r1", "r2")
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    dropped = cut(dropped.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), "__dropped"), "dropped-lines")
    split = F.split(text_or_empty("text"), "\n", -1)
    kept = bind(
        split,
        lambda all_lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__dropped")), lambda i: F.get(all_lines, i)), "\n"
        ),
    )
    joined = docs.join(dropped, (F.xxhash64("doc_id", "text") == F.col("__r1")) & (F.xxhash64(F.lit(7), "doc_id", "text") == F.col("__r2")), "left")
    return joined.withColumns(
        {
            "n_lines": F.size(split).cast("long"),
            "n_dropped": F.when(F.col("__dropped").isNull(), F.lit(0)).otherwise(F.size("__dropped")).cast("long"),
            "text": F.when(F.col("__dropped").isNull(), text_or_empty("text")).otherwise(kept),
        }
    ).drop("__r1", "__r2", "__dropped")
