"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 values of the
text's word shingles. Two fingerprints link at ``radius`` or fewer differing bits.

Every distinct fingerprint emits all its variants within ``radius / 2`` bits. Two of them collide
on a variant just if they differ in at most ``radius`` bits: a half of the differing bits leads
from either to the middle. The shuffle is on variants, by some of their bits: a bucket holds
the variants that agree on the chosen bits. A fingerprint reaches only the buckets that differ from its own
in ``radius / 2`` of these bits, so one row per fingerprint and bucket is shuffled, with
the number of flips that are left, and its variants in that bucket are made where they
meet. With r chosen bits that is 1 + r + r (r - 1) / 2 rows at radius 4, not 2,081, and each
variant is still made once.

The chosen bits are those set in closest to half of all fingerprints, as many as give
``VARIANTS`` variants a bucket on average. A bucket over twice that many is dealt anew
by the next bits until none is left, down to a bucket for each variant, which only the fingerprints
of one small ball can reach. So groups of near copies split however many rows they hold;
exact copies are one fingerprint from the start.

In a bucket, equal variants are found by sorting. Colliding pairs (each with the least fingerprint of the variant)
are deduplicated and verified by their differing bits, and a spanning forest of them leaves. Connected
components over all buckets' edges then give the classes.

Defined cases: a text with fewer words than a shingle has one shingle of all of them; a text
without words (null, empty, white space) has fingerprint zero and links like any other; rows
with a null doc_id take part, and a component of such rows only has a null component_id;
repeated rows share their fingerprint; empty tables give no rows; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, importable, text_or_empty
from lakeaudit.llm.url_filter import connected_components

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
BITS = 64
VARIANTS = 4_000_000
MORE_BITS = 6
BLOCK = 100_000

#: Byte j of entry b is bit j of b: sums of up to 255 entries count all eight bits at once.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(hashed: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """int64 [parts, 64]: how often each bit is set in the values of each part; parts begin at ``begins`` and are not empty."""
    sizes = np.diff(np.append(begins, len(hashed)))
    chunks = -(-sizes // 255)
    first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    inner = np.arange(chunks.sum()) - np.repeat(first, chunks)
    lanes = np.add.reduceat(LANES[hashed.view(np.uint8).reshape(-1, 8)], np.repeat(begins, chunks) + 255 * inner, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).reshape(-1, BITS), first, axis=0, dtype=np.int64)


def _shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    if len(words) < n:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, k, None) for k in range(n))))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            counts, totals = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
            parts: list[np.ndarray] = []
            owners: list[int] = []

            def add() -> None:
                sizes = np.array([len(p) for p in parts])
                np.add.at(counts, owners, bit_counts(np.concatenate(parts), np.cumsum(sizes) - sizes))
                np.add.at(totals, owners, sizes)
                parts.clear()
                owners.clear()

            pending = 0
            for row in range(len(texts)):
                hashed = map(xxh64_intdigest, _shingles(texts[row].as_py().lower().split(), shingle_words), repeat(SEED))
                while len(part := np.fromiter(islice(hashed, BLOCK), np.uint64)):
                    parts.append(part)
                    owners.append(row)
                    pending += len(part)
                    if pending >= BLOCK:
                        add()
                        pending = 0
            if parts:
                add()
            bits = np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(positions: list[int], most: int) -> list[tuple[int, int]]:
    """(mask, number of flips) for every choice of at most ``most`` of the bits."""
    return [(sum(1 << p for p in chosen), k) for k in range(most + 1) for chosen in combinations(positions, k)]


def _weight(free: Column, left: Column, most: int) -> Column:
    """How many variants a fingerprint makes of so many free bits and flips."""
    out, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, most + 1):
        term = term * F.greatest(free - F.lit(k - 1), F.lit(0)) / F.lit(k)
        out = out + F.when(left >= k, term).otherwise(0.0)
    return out


def _deal(rows: DataFrame, positions: list[int], most: int) -> DataFrame:
    """Rows (fingerprint, bucket, free, left) dealt further by the given bits."""
    taken = sum(1 << p for p in positions)
    ways = F.array(*[F.struct(F.lit(_signed(mask)).alias("mask"), F.lit(k).alias("used")) for mask, k in _flips(positions, most)])
    own = F.col("fingerprint").bitwiseAND(F.lit(_signed(taken)))
    return rows.select("*", F.explode(F.filter(ways, lambda w: w["used"] <= F.col("left"))).alias("way")).select(
        "fingerprint",
        F.col("bucket").bitwiseOR(own.bitwiseXOR(F.col("way.mask"))).alias("bucket"),
        F.col("free").bitwiseAND(F.lit(_signed(~taken & (1 << 64) - 1))).alias("free"),
        (F.col("left") - F.col("way.used")).alias("left"),
    )


def _meet(radius: int):
    """The links of one bucket: a spanning forest of the pairs whose variants are equal."""

    def meet(table: pa.Table) -> pa.Table:
        free = int(table.column("free")[0].as_py())
        codes, left = table.column("fingerprint").to_numpy().view(np.uint64), table.column("left").to_numpy()
        order = np.argsort(codes)
        codes, left = codes[order], left[order]
        masks = _flips([p for p in range(BITS) if free >> p & 1], int(left.max()))
        flips, used = np.array([m for m, _ in masks], np.uint64), np.array([k for _, k in masks])
        made, owner = [], []
        for budget in np.unique(left):
            rows, own = np.flatnonzero(left == budget).astype(np.int32), flips[used <= budget]
            made.append((codes[rows][:, None] ^ own[None, :]).ravel())
            owner.append(np.repeat(rows, len(own)))
        # All variants here agree on the chosen bits once the bucket's own flips are made, so the free bits tell them apart.
        made, owner = np.concatenate(made) & np.uint64(free & (1 << 64) - 1), np.concatenate(owner)
        by = np.argsort(made, kind="stable")
        made, owner = made[by], owner[by]
        new = np.ones(len(made), bool)
        new[1:] = made[1:] != made[:-1]
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(owner, np.flatnonzero(new))[group]
        apart = least != owner
        pairs = np.unique(least[apart].astype(np.int64) * len(codes) + owner[apart])
        a, b = pairs // len(codes), pairs % len(codes)
        near = np.bitwise_count(codes[a] ^ codes[b]) <= radius
        a, b = a[near], b[near]
        root = np.arange(len(codes))
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        linked = np.flatnonzero(root != np.arange(len(codes)))
        return pa.table([pa.array(codes[root[linked]].view(np.int64)), pa.array(codes[linked].view(np.int64))], names=["a", "b"])

    return meet


def ball_links(codes: DataFrame, radius: int = RADIUS, variants: int = VARIANTS) -> DataFrame:
    """Edges (a, b) that join all distinct ``fingerprint`` values linked at ``radius`` or fewer differing bits."""
    importable(codes.sparkSession)
    half = radius // 2
    if radius % 2 or not 2 <= radius <= 8:
        raise ValueError("radius must be 2, 4, 6 or 8")
    bit = [F.sum(F.shiftright("fingerprint", j).bitwiseAND(F.lit(1))).alias(f"bit{j}") for j in range(BITS)]
    total, *ones = codes.agg(F.count(F.lit(1)), *bit).first()
    balance = sorted(range(BITS), key=lambda j: (abs(2 * (ones[j] or 0) - total), j))
    ball = sum(math.comb(BITS, k) for k in range(half + 1))
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total * ball / variants)))))
    rows = codes.select("fingerprint", F.lit(0).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("free"), F.lit(half).alias("left"))
    used, done = 0, None
    while True:
        rows = cut(_deal(rows, balance[used : used + bits], half), f"balls-{used}")
        used += bits
        if used < BITS:
            size = F.sum(_weight(F.bit_count("free"), F.col("left"), half))
            large = cut(rows.groupBy("bucket").agg(size.alias("size")).where(F.col("size") > 2 * variants).select("bucket"), "large-balls")
            over = not large.isEmpty()
        else:
            over = False
        small = rows.join(large, "bucket", "left_anti") if over else rows
        found = small.groupBy("bucket", "free").applyInArrow(_meet(radius), "a long, b long")
        found = cut(found, f"ball-links-{used}")
        done = found if done is None else done.unionByName(found)
        if not over:
            return done.distinct()
        rows, bits = rows.join(large, "bucket", "left_semi"), min(MORE_BITS, BITS - used)


def near_components(docs: DataFrame, radius: int = RADIUS, variants: int = VARIANTS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id (the smallest doc_id reachable) for every row of ``docs``."""
    signed = cut(fingerprints(docs), "simhash")
    codes = cut(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "simhash-codes")
    joined = connected_components(ball_links(codes, radius, variants))
    named = codes.join(joined, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    named = cut(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = cut(named.join(ids, "root").select("fingerprint", "component_id"), "simhash-components")
    return signed.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
