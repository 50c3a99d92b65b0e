"""Benchmark decontamination: size-partitioned MinHash containment (built-in functions only).

A test item is contained in a document when at least ``threshold`` of the item's distinct
``n``-word shingles are shingles of the document. MinHash similarity of a short item and a
long document is near zero, so the search estimates containment instead: for each of
``SKETCH`` hash functions the item's least shingle is a shingle of the document with a
probability equal to the containment.

Items are partitioned by size: an item of at most ``SKETCH`` shingles is sketched by all
of them (its count is exact); a larger one by its least shingle under each function.
Documents with too few shingles for an item's size class are not candidates. A candidate
needs ``hit_share`` of the sketch; at a containment of 0.8 and 16 functions, a quarter is
missed with a probability below one in a million. Candidates are then verified by exact
shingle containment.

The sketches are broadcast only when their counted rows are under ``BROADCAST_ROWS``;
beyond that the shingles meet them in a shuffled join. Shingles that a third of all
documents share meet one sketch row each and are counted per document.

Defined cases: null and empty texts, and items under ``n`` words, have no shingles and are
never contained nor contaminated; search and filter judge each row by its own text, whatever its
id, and the search reports an id (null is one of its own) once per item, with the most shingles that one of
its rows shares; rows with one item_id are one item; empty tables give no rows; other
input columns are ignored by the search and returned by the filter.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, shingle_array, word_array

SHINGLE_WORDS, THRESHOLD, SKETCH, HIT_SHARE = 5, 0.8, 16, 0.25
BROADCAST_ROWS = 200_000


def _shingles(text: Column, n: int) -> Column:
    return shingle_array(word_array(text), n)


def _equal(left: list[str], right: list[str]) -> Column:
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)))


def _row_keys() -> dict[str, Column]:
    """128 bits of a row's id and text; equal rows have equal verdicts."""
    return {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(7), "doc_id", "text")}


def _search(own: DataFrame, keys: list[str], items: DataFrame, threshold: float, n: int, sketch: int, hit_share: float) -> DataFrame:
    """``keys``, item_id, n_shared, n_item, containment of every item contained in the text of one key.
    ``own`` has the keys, which tell a row's text, and the text."""
    parts = items.select("item_id", F.explode(_shingles(F.col("text"), n)).alias("s")).distinct()
    sizes = parts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), F.collect_list("s").alias("all"))
    sizes = cut(sizes, "items")
    least = [
        F.array_min(F.transform("all", lambda s, k=k: F.struct(F.xxhash64(F.lit(k), s).alias("h"), s.alias("s"))))["s"]
        for k in range(sketch)
    ]
    small = F.col("n_item") <= sketch
    sketches = sizes.select(
        "item_id",
        "n_item",
        # the size class: a document needs this many shingles
        F.ceil(F.pow(F.lit(2.0), F.floor(F.log2("n_item"))) * threshold).cast("long").alias("least_size"),
        F.when(small, F.col("all")).otherwise(F.array_distinct(F.array(*least))).alias("sketch"),
    )
    sketches = sketches.select(
        "item_id",
        "least_size",
        F.ceil(F.size("sketch") * hit_share).alias("needed"),
        F.explode("sketch").alias("s"),
    )
    sketches = cut(sketches, "sketches")
    bounded = sketches.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # explode_outer: explode would filter by the list first, which computes the shingles once more for each condition.
    shingles = own.select(*keys, _shingles(F.col("text"), n).alias("list")).select(
        *keys, F.size("list").alias("doc_size"), F.explode_outer("list").alias("s")
    )
    met = shingles.join(F.broadcast(sketches) if bounded else sketches, "s")
    hits = (
        met.where(F.col("doc_size") >= F.col("least_size"))
        .groupBy(*keys, "item_id", "needed", "s")
        .agg(F.lit(1).alias("one"))
        .groupBy(*keys, "item_id", "needed")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    candidates = cut(hits.where(F.col("hits") >= F.col("needed")).select(*keys, "item_id"), "candidates")
    # Exact containment: the shingles of documents with a candidate, against the candidates' items.
    asked_keys = [f"asked_{key}" for key in keys]
    asked = cut(candidates.select(*(F.col(key).alias(name) for key, name in zip(keys, asked_keys))).distinct(), "candidate-documents")
    texts = own.join(asked, _equal(keys, asked_keys), "left_semi")
    exact = texts.select(*keys, F.explode(F.array_distinct(_shingles(F.col("text"), n))).alias("s"))
    wanted = cut(sizes.select("item_id", "n_item", F.explode("all").alias("s")), "item-shingles")
    wide = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    shared = (
        exact.join(F.broadcast(wanted) if wide else wanted, "s")
        .groupBy(*keys, "item_id", "n_item", "s")
        .agg(F.lit(1).alias("one"))
        .groupBy(*keys, "item_id", "n_item")
        .agg(F.count(F.lit(1)).alias("n_shared"))
        .where(F.col("n_shared") >= threshold * F.col("n_item"))
    )
    pair = candidates.select(*(F.col(key).alias(name) for key, name in zip(keys, asked_keys)), F.col("item_id").alias("i"))
    return shared.join(pair, _equal([*keys, "item_id"], [*asked_keys, "i"]), "left_semi").select(
        *keys, "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def find_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS, sketch: int = SKETCH, hit_share: float = HIT_SHARE
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every contained item."""
    keys = _row_keys()
    own = docs.select("doc_id", *(key.alias(name) for name, key in keys.items()), "text")
    found = _search(own, ["doc_id", *keys], items, threshold, n, sketch, hit_share)
    best = found.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return best.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    keys = _row_keys()
    own = docs.select(*(key.alias(name) for name, key in keys.items()), "text")
    found = _search(own, list(keys), items, threshold, n, SKETCH, HIT_SHARE)
    bad = cut(found.select(F.col("__k1").alias("__bad1"), F.col("__k2").alias("__bad2")).distinct(), "contaminated")
    return docs.withColumns(keys).join(bad, _equal(list(keys), ["__bad1", "__bad2"]), "left_anti").select(*docs.columns)
