"""The corpus pipeline: documents to packed sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next stage's documents. All stages but
the last return the columns of ``documents``; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, read_table
from lakeaudit.llm.decontaminate import drop_contaminated
from lakeaudit.llm.line_dedup import drop_frequent_lines
from lakeaudit.llm.ngram_join import keep_one
from lakeaudit.llm.packing import pack, tokenize
from lakeaudit.llm.quality import keep_good
from lakeaudit.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer rejects go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least ten documents go from every text; n_chars follows the text."""
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}  # named like the counts that are added
    cleaned = drop_frequent_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped")
    cleaned = cleaned.withColumnsRenamed({name: c for c, name in own.items()})
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their sequences."""
    return pack(tokenize(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The classifier, the tokenizer and the packing have no SQL form; tests hold each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut(docs, f"stage-{at}")
    return docs
