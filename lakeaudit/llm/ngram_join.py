"""N-gram Jaccard join with Bayesian pruning of MinHash comparisons.

Texts are sets of five-word shingles. Texts with equal sets are one class of copies; the
join works on one representative per class and weighs it by its copies.

1. Candidates: ``HASHES`` MinHash values in bands of ``BAND`` values. Representatives that
   agree on a whole band meet; connected components over "same band" (star edges, one per
   member and bucket, never pairs) bring each of them to one group.
   A pair at similarity s shares no band with a probability of (1 - s^BAND)^(HASHES / BAND):
   1.4e-7 at 0.8, and less above; it is then missed unless other texts connect it.
2. A group compares every pair of compatible sizes ``BAND * STEP`` values at a time,
   whether or not the two share a band. After n values with m agreeing, the similarity's
   posterior under a uniform prior is Beta(m + 1, n - m + 1); a pair is dropped once its
   probability of reaching the threshold falls below ``TOLERANCE``. Over all steps this drops a pair at exactly 0.8
   with a probability of 6.1e-6, and less above.
3. Every pair that is left is verified by the exact Jaccard similarity of the shingle sets.

A group counts links and emits one spanning edge per linked member, not its pairs. Groups
above ``GROUP_ROWS`` members are dealt out: first by size class (similar sets have similar
sizes, so a member meets its own and the next class), then in blocks, each pair of blocks
in one task. So no bucket is capped, and a group that holds a third of all rows is spread.

Result: per row doc_id, class_id (least doc_id of its component of links), n_links (other
rows whose similarity reaches the threshold, copies included).

Defined cases: texts of one to four words have one shingle of all their words; texts
without words are alike only if equal, and null is the empty text; rows with a null
doc_id take part, and a class of such rows only has a null class_id; repeated rows are
copies of each other; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, drop_caches, importable, text_or_empty, word_array
from lakeaudit.llm.url_filter import connected_components

SHINGLE_WORDS, THRESHOLD = 5, 0.8
HASHES, BAND, STEP, TOLERANCE = 120, 4, 5, 1e-6
GROUP_ROWS = 4_096
SLICE_WORDS = 200_000

SIGNED = "doc_id long, t1 long, t2 long, n long, f1 long, f2 long, signature binary"
LINKED = "node string, root string, links long"

_rng = np.random.default_rng(20240607)
MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads close values."""
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(text: Column) -> Column:
    """Hashes of the words; of the whole text where it has none."""
    hashes = F.transform(word_array(text), lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.xxhash64(F.lit("no words"), text))))[0]


def text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")


def shingles(words: np.ndarray, starts: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in ``words`` (texts start at ``starts``), sorted within
    each text, and where each text's begin (with the end appended)."""
    sizes = np.diff(starts)
    counts = np.where(sizes >= n, sizes - n + 1, 1)
    begin = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = starts[:-1][owner] + np.arange(begin[-1]) - begin[owner]
    padded = np.concatenate((words.view(np.uint64), np.zeros(n, np.uint64)))
    left = starts[1:][owner] - first
    hashed = np.zeros(len(first), np.uint64)
    for k in range(n):
        part = padded[first + k] * MIX[2 + k]
        if k:
            part = np.where(left > k, part, np.uint64(k))
        hashed = mixed(hashed + part)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    hashed, owner = hashed[new], owner[new]
    return hashed, np.searchsorted(owner, np.arange(len(sizes) + 1))


def signatures(hashed: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """uint32 [texts, HASHES]: the least value of each hash function over a text's shingles."""
    out = np.empty((len(begin) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(hashed * MULTIPLY[k] + ADD[k], begin[:-1]) >> np.uint64(32)
    return out


def least_agreeing(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """For each number n of compared values, the least number that must agree."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= threshold
    out = []
    for n in steps:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[above].sum() / weight.sum() >= tolerance:
                break
        out.append(m)
    return out


def _slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = max(at + 1, to)
        yield at, to
        at = to


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(), column.offsets.to_numpy().astype(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, the number of shingles, a 128-bit fingerprint of their set, and the MinHash signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches("ngram_join")
        for batch in batches:
            words, offsets = _lists(batch.column(3))
            for at, to in _slices(offsets, SLICE_WORDS):
                own = words[offsets[at] : offsets[to]]
                hashed, begin = shingles(own, offsets[at : to + 1] - offsets[at])
                f1 = np.add.reduceat(mixed(hashed * MIX[20]), begin[:-1])
                f2 = np.add.reduceat(mixed(hashed * MIX[21]), begin[:-1])
                signed = signatures(hashed, begin)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, to - at) for c in range(3)), pa.array(np.diff(begin)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([row.tobytes() for row in signed], pa.binary())],
                    ["doc_id", "t1", "t2", "n", "f1", "f2", "signature"],
                )

    text = text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long"), *text_key(text), word_hashes(text)).mapInArrow(run, SIGNED)


def _linked(sets: list[np.ndarray], signed: np.ndarray, compare: np.ndarray, threshold: float, needed: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later members it is linked with; ``compare[i, j]`` says whether i and j may be compared."""
    count, size = len(sets), np.array([len(s) for s in sets])
    width = BAND * STEP
    flat, index = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))
    universe, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(universe), np.int32)
    for i in range(count - 1):
        later = np.flatnonzero(compare(i)) if callable(compare) else np.arange(i + 1, count)
        later = later[np.minimum(size[later], size[i]) >= threshold * np.maximum(size[later], size[i]) - 1e-9]
        agree = np.zeros(len(later), np.int64)
        for step, least in enumerate(needed):  # incremental comparison
            if not len(later):
                break
            at = step * width
            agree += (signed[later, at : at + width] == signed[i, at : at + width]).sum(axis=1)
            left = agree >= least
            later, agree = later[left], agree[left]
        if not len(later):
            continue
        mark[flat[index[i] : index[i + 1]]] = 1
        if len(later) * 4 > count - i:
            cover = np.add.reduceat(mark[flat[index[i + 1] :]], index[i + 1 : -1] - index[i + 1])[later - i - 1]
        else:
            cover = np.array([mark[flat[index[j] : index[j + 1]]].sum() for j in later.tolist()])
        mark[flat[index[i] : index[i + 1]]] = 0
        exact = cover / (size[later] + size[i] - cover)
        yield i, later[exact >= threshold - 1e-12]


def _components(docs: DataFrame, threshold: float, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, node of every row; and per node its copies, links, component (root) and source, the least (unnamed, doc_id, t1, t2) of its rows."""
    spark = docs.sparkSession
    importable(spark)
    steps = list(range(BAND * STEP, HASHES + 1, BAND * STEP))
    needed = least_agreeing(threshold, TOLERANCE, steps)
    signed = cut(sign(docs), "signatures")
    node = F.concat(F.lower(F.lpad(F.hex("f1"), 16, "0")), F.lower(F.lpad(F.hex("f2"), 16, "0")))
    members = signed.select("doc_id", "n", node.alias("node"))
    # One row per set of shingles; equal sets have equal signatures.
    classes = cut(
        signed.groupBy(node.alias("node"), "n")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "t1", "t2")).alias("source"), F.min("signature").alias("signature"))
        .select("*", F.col("source.doc_id").alias("least_id")),
        "classes",
    )
    bands = classes.select(
        "node",
        F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 4 * b + 1, 4 * BAND)) for b in range(0, HASHES, BAND)])).alias("band", "bucket"),
    )
    stars = bands.groupBy("band", "bucket").agg(F.min("node").alias("star"), F.count(F.lit(1)).alias("met"))
    stars = cut(stars.where("met > 1").select("band", "bucket", "star"), "buckets")
    meet = bands.join(stars, ["band", "bucket"]).where("node <> star")
    groups = cut(connected_components(meet.select(F.col("star").alias("a"), F.col("node").alias("b")).distinct()), "groups")

    step = math.log(1 / threshold)
    placed = classes.join(groups, "node").select(
        "node", "root", "copies", "n", "signature", F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)).cast("int").alias("own")
    )
    placed = cut(placed, "candidates")
    per_class = placed.groupBy("root", "own").agg(F.count(F.lit(1)).alias("here"))
    total = per_class.groupBy("root").agg(F.sum("here").alias("total"))
    small = total.where(F.col("total") <= group_rows).select("root")
    buckets = max(1, math.ceil((placed.count() or 1) / group_rows))
    # Small groups travel together; a large one is dealt by size class and block.
    near = per_class.select("root", F.explode(F.array("own", F.col("own") + 1)).alias("size_class"), "here").groupBy("root", "size_class").agg(F.sum("here").alias("here"))
    blocks = cut(
        near.join(total.where(F.col("total") > group_rows), "root").select(
            F.col("root").alias("of"), F.col("size_class").alias("of_class"), F.ceil(F.col("here") / F.lit(group_rows)).cast("int").alias("blocks")
        ),
        "blocks",
    )
    together = placed.join(cut(small, "small-groups"), "root", "left_semi").select(
        "node", "root", F.lit(-1).alias("size_class"), F.lit(0).alias("i"), F.lit(0).alias("j"), "copies", "own", F.lit(0).alias("block"), "signature",
        F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("task"),
    )
    dealt = placed.select("*", F.explode(F.array("own", F.col("own") + 1)).alias("size_class")).join(
        blocks, (F.col("root") == F.col("of")) & (F.col("size_class") == F.col("of_class"))
    ).select("node", "root", "size_class", "copies", "own", "signature", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
        "node", "root", "size_class", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "copies", "own", "block", "signature"
    )
    dealt = dealt.withColumn("task", F.xxhash64("root", "size_class", "i", "j"))
    work = together.unionByName(dealt)

    # The words come from one row of each class.
    first = classes.join(placed.select("node"), "node", "left_semi").select(
        "node", F.col("least_id").alias("doc"), F.col("source.t1").alias("s1"), F.col("source.t2").alias("s2")
    )
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")).select("doc_id", "text", *text_key(F.col("text")))
    texts = rows.join(
        cut(first, "sources"), (F.col("t1") == F.col("s1")) & (F.col("t2") == F.col("s2")) & F.col("doc_id").eqNullSafe(F.col("doc"))
    ).select("node", word_hashes(F.col("text")).alias("words"))

    def link(table: pa.Table) -> pa.Table:
        drop_caches("ngram_join")
        roots, classes_, lows, highs = (table.column(c).to_pylist() for c in ("root", "size_class", "i", "j"))
        nodes = np.array(table.column("node").to_pylist(), object)
        own, block, copies = (table.column(c).to_numpy() for c in ("own", "block", "copies"))
        raw = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        words, offsets = _lists(table.column("words").combine_chunks())
        hashed, begin = shingles(words[offsets[0] : offsets[-1]], offsets - offsets[0])
        parts: dict[tuple, list[int]] = {}
        for place, key in enumerate(zip(roots, classes_, lows, highs)):
            parts.setdefault(key, []).append(place)
        edges: tuple[list, list, list] = ([], [], [])
        for (_, size_class, low, high), places in parts.items():
            # a row may hold another text of the same doc_id; each node is taken once
            places = np.array(places)
            places = places[np.unique(nodes[places].astype(str), return_index=True)[1]]
            if len(places) < 2:
                continue
            mine, at = own[places], block[places]

            def compare(i: int) -> np.ndarray:
                may = np.arange(len(places)) > i
                if size_class >= 0:
                    may &= (mine == size_class) | (mine[i] == size_class)
                    if low != high:
                        may &= at != at[i]
                return may

            links, root = np.zeros(len(places), np.int64), np.arange(len(places))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            sets = [hashed[begin[p] : begin[p + 1]] for p in places]
            for i, others in _linked(sets, raw[places], compare, threshold, needed):
                links[i] += copies[places[others]].sum()
                links[others] += copies[places[i]]
                for j in others.tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
            for i in np.flatnonzero(links).tolist():
                edges[0].append(nodes[places[i]])
                edges[1].append(nodes[places[find(i)]])
                edges[2].append(int(links[i]))
        return pa.table([pa.array(edges[0], pa.string()), pa.array(edges[1], pa.string()), pa.array(edges[2], pa.int64())], names=["node", "root", "links"])

    found = cut(work.join(texts, "node").groupBy("task").applyInArrow(link, LINKED), "links")
    joined = connected_components(
        found.where("node <> root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).distinct()
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "copies", "source").join(joined, "node", "left").join(counts, "node", "left")
    return members, named.select("node", "copies", "source", "links", F.coalesce("root", "node").alias("root"))


def join_near(docs: DataFrame, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text)."""
    members, named = _components(docs, threshold, group_rows)
    named = named.withColumn("least_id", F.col("source.doc_id"))
    class_ids = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = named.join(class_ids, "root").select(
        "node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return members.join(cut(named, "classes-named"), "node").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component of links, with all its columns: a row of the least doc_id
    (null comes last), and of texts with that id the one with the least hash."""
    named = _components(docs, threshold, GROUP_ROWS)[1]
    first = named.groupBy("root").agg(F.min("source").alias("source")).select(
        F.col("source.doc_id").alias("__doc"), F.col("source.t1").alias("__s1"), F.col("source.t2").alias("__s2")
    )
    t1, t2 = text_key(text_or_empty("text"))
    same = (F.col("__t1") == F.col("__s1")) & (F.col("__t2") == F.col("__s2")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc"))
    kept = docs.withColumns({"__t1": t1, "__t2": t2}).join(cut(first, "kept-rows"), same, "left_semi")
    return kept.dropDuplicates(["doc_id", "__t1", "__t2"]).select(*docs.columns)
