"""Nearest neighbours by inner product with multi-index hashing.

Codes: vectors are centred and rotated by a learned matrix (iterative quantization: an
orthogonal rotation that brings the sample's principal coordinates nearest to their signs)
and each coordinate's sign is a bit. The code is split into substrings of ``BITS`` bits,
and every shard of the index holds, per substring, its rows sorted by substring value.

Search: a code within Hamming radius r of the query's differs from it by at most
r // m in one of the m substrings (pigeonhole), so probing every substring value within
that distance retrieves every code in the radius. What is retrieved and lies in the radius
is reranked by the float vectors in double precision. The radius is learned: the least one
that holds ``RECALL`` of the true neighbours of sampled queries in the sample.
A query that finds fewer than k rows in a shard scans that shard, so no result is short.

Fitting uses at most ``FIT_ROWS`` rows with the least hash; every row is indexed. Shards
hold about ``SHARD_ROWS`` rows dealt by hash, queries go to every shard in blocks of about
``BLOCK_QUERIES``, and each task keeps k rows per query, so a vector that a third of all
rows repeat makes neither a hot task nor a long list.

Defined cases: vectors that are null, empty, zero, of another length than the most common
one, or hold null or non-finite components take no part, neither as query nor as
candidate, nor do rows with a null id; equal scores go to the smaller vec_id; every row is a
row of its own: rows of one vec_id are each a candidate for the others, and ask each for themselves (the
result then has a list for each of them under that query_id); fewer than k candidates are all returned; an empty table gives
no rows; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, importable

K, BITS, RECALL = 20, 8, 0.99
FIT_ROWS, FIT_QUERIES, FIT_ROUNDS = 8192, 256, 30
SHARD_ROWS, BLOCK_QUERIES = 16_384, 2_048
FOUND = "query long, query_id long, vec_id long, score double"


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; each row's value does not depend on its place."""
    return (vectors * query).sum(axis=1)


class Codes:
    """Learned rotated binary codes."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        dim = x.shape[1]
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        axes = axes.T if axes.shape[0] == dim else np.eye(dim)
        v = x @ axes
        r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        for _ in range(FIT_ROUNDS):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        self.rotation = axes @ r
        self.bits = -(-dim // BITS) * BITS

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """uint8 [rows, m]: the code, one substring of BITS bits per column."""
        if not len(x):
            return np.zeros((0, self.bits // BITS), np.uint8)
        signs = (x - self.mean) @ self.rotation >= 0
        return np.packbits(signs, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def learn_radius(codes: Codes, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The least radius that holds ``recall`` of the k true neighbours of sampled queries."""
    own = codes.substrings(sample)
    far = []
    for i in range(0, len(sample), max(1, len(sample) // FIT_QUERIES)):
        s = scores(sample, sample[i])
        s[i] = -np.inf
        best = np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)]
        far.append(hamming(own[best], own[i]))
    return int(np.quantile(np.concatenate(far), recall, method="higher")) if far else codes.bits


class Index:
    """One shard: its rows, and per substring the rows sorted by value."""

    def __init__(self, codes: Codes, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, radius: int):
        order = np.lexsort((rows, ids))
        self.codes, self.numbers, self.ids, self.vectors, self.radius = codes, rows[order], ids[order], vectors[order], radius
        self.code = codes.substrings(self.vectors)
        self.rows = [np.argsort(column, kind="stable") for column in self.code.T]
        self.starts = [np.searchsorted(column[rows], np.arange(2**BITS + 1)) for column, rows in zip(self.code.T, self.rows)]
        flips = np.arange(2**BITS, dtype=np.uint8)
        self.probes = flips[np.bitwise_count(flips) <= radius // self.code.shape[1]]

    def retrieve(self, code: np.ndarray) -> np.ndarray:
        """Places of every row whose code lies in the radius."""
        hit = np.zeros(len(self.ids), bool)
        for value, rows, starts in zip(code, self.rows, self.starts):
            near = (self.probes ^ value).astype(np.int64)
            begin, count = starts[near], starts[near + 1] - starts[near]
            total = int(count.sum())
            if total:
                first = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count)
                hit[rows[first + np.arange(total)]] = True
        found = np.flatnonzero(hit)
        return found[hamming(self.code[found], code) <= self.radius]

    def search(self, own: int, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.retrieve(code)
        found = found[self.numbers[found] != own]
        if len(found) < k:
            found = np.flatnonzero(self.numbers != own)
        s = scores(self.vectors[found], query)
        best = np.lexsort((self.ids[found], -s))[:k]
        return self.ids[found][best], s[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    )
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (common["dim"] if common else 0))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = 20, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose vec_id is divisible by ``every``."""
    importable(vectors.sparkSession)
    rows = cut(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers fixed when written
    fit = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    if not fit.num_rows:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dim = len(fit.column("v")[0])
    sample = _matrix(fit.column("v"), dim)
    codes = Codes(sample)
    radius = learn_radius(codes, sample, k)
    count = rows.count()
    shards = max(1, -(-count // shard_rows))
    blocks = max(1, -(-count // (every * BLOCK_QUERIES)))
    queries = rows.where(F.col("vec_id") % every == 0)

    base = rows.select(
        F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row", "vec_id", "v", F.lit(False).alias("asks")
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(blocks)).cast("int").alias("block"), "row", "vec_id", "v", F.lit(True).alias("asks")
    )

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        numbers, ids, v = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
        index = Index(codes, numbers[~asks], ids[~asks], v[~asks], radius)
        out: tuple[list, list, list, list] = ([], [], [], [])
        asking, asking_codes = v[asks], codes.substrings(v[asks])
        for own, query_id, query, code in zip(numbers[asks].tolist(), ids[asks].tolist(), asking, asking_codes):
            found, s = index.search(own, query, code, k)
            out[0].append(np.full(len(found), own, np.int64))
            out[1].append(np.full(len(found), query_id, np.int64))
            out[2].append(found)
            out[3].append(s)
        empty = [np.zeros(0, np.int64)]
        return pa.table(
            [*(pa.array(np.concatenate(x or empty)) for x in out[:3]), pa.array(np.concatenate(out[3] or [np.zeros(0)]))],
            names=["query", "query_id", "vec_id", "score"],
        )

    found = base.unionByName(asked).groupBy("shard", "block").applyInArrow(search, FOUND)
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score")))
    best = found.groupBy("query", "query_id").agg(F.slice(order, 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )
