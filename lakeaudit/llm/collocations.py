"""Phrase collocations by tiled pair counting.

Texts are cut into pieces and words, and every language (null: ``und``) is counted on its own.
Blocks of about ``BLOCK_WORDS`` words hold the texts as numbers: first places in the
block's own list of words, then ids of the frequent words. Words are dealt to buckets by a hash, and
a bucket numbers its frequent words by frequency, all buckets in turn: the ids are the ranks by frequency
over the language but for the chance in the deal, so frequent words have small ids.

A level counts the pairs of neighbouring ids in each block. The id matrix is split into tiles of
``TILE`` x ``TILE``; a tile that meets many of a block's pairs is counted by direct addresses with
one dense bincount, all sparse tiles together as sorted coordinates. What a block has counted
(each pair once) is dealt to buckets by a hash of the pair, one for about ``BUCKET_WORDS`` words, and
summed as sorted coordinates; so no pair, tile or language can fill a bucket. Pairs with
``least`` occurrences are ranked anew and become the ids of the next level, in the places
where they begin: a neighbour pair of two-word ids is a three-word phrase, and so on up to
``most_words``. A phrase as frequent as that consists of two such parts, so no candidate is lost.

A bucket answers every block with the ids of its own frequent words or pairs, so no
dictionary is sent whole to a task or to the driver. All numbers travel as packed arrays.

Scores: a candidate with a occurrences, cut after its first k words into parts with l
and r occurrences, has floor(1000 a n / (l r)) for the lowest-scoring cut (ties to the smallest k),
in DECIMAL(38, 0). n counts all words of the language. A candidate goes if a longer one holds its words
and is as frequent; then one with one word more does, which is what is looked up.

Defined cases: null and empty texts have no words; a null language and ``und`` are one; repeated rows and rows with null
ids count each; other input columns are ignored; empty tables and tables without frequent phrases give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, drop_caches, importable, text_or_empty

LEAST, MOST_WORDS, TOP = 100, 5, 2_000
BLOCK_WORDS, BUCKET_WORDS = 500_000, 4_000_000
TILE, DENSE = 256, 1 / 16
RANK_PARTS = 64

#: Fixed values of the contract: characters that end a piece; they and tabs are mapped before the text is split at spaces.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SPLIT = bytes.maketrans(ENDS + b"\t", b"." * len(ENDS) + b" ")

BLOCKS = "lang string, block long, size long, words array<string>, counts binary, codes binary"
DEALT_WORDS = "lang string, bucket int, block long, words array<string>, places binary, n binary"
DEALT_PAIRS = "lang string, bucket int, block long, a binary, b binary, n binary"
SUMMED = "lang string, block long, told binary, id array<long>, n array<long>, word array<string>, a array<long>, b array<long>"


def to_planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, so that the many zero bytes lie together, and compressed."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def from_planes(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


class Places(dict):
    """Each new word gets the next number; the end of a piece has -1."""

    def __init__(self):
        self[b"."] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) - 1
        return place


def count_pairs(codes: np.ndarray, tile: int = TILE, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (a, b) of neighbouring ids and how often each occurs; -1 is no id."""
    a, b = codes[:-1], codes[1:]
    both = (a >= 0) & (b >= 0)
    a, b = a[both], b[both]
    if not len(a):
        return a, b, a
    # Places in the order of the ids met: few enough for one number per tile and pair.
    met = np.unique(np.concatenate((a, b)))
    bands = np.unique(met // tile)
    x, y = np.searchsorted(bands, a // tile), np.searchsorted(bands, b // tile)
    own = x * len(bands) + y
    order = np.argsort(own, kind="stable")
    a, b, own = a[order], b[order], own[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sizes = np.diff(np.append(starts, len(own)))
    full = sizes >= dense * tile * tile
    out_a, out_b, out_n = [], [], []
    for start, size in zip(starts[full].tolist(), sizes[full].tolist()):  # direct addresses
        part = slice(start, start + size)
        low_a, low_b = a[start] // tile * tile, b[start] // tile * tile
        counted = np.bincount((a[part] - low_a) * tile + b[part] - low_b, minlength=tile * tile)
        cells = np.flatnonzero(counted)
        out_a.append(low_a + cells // tile)
        out_b.append(low_b + cells % tile)
        out_n.append(counted[cells])
    rest = np.repeat(~full, sizes)
    if rest.any():  # sorted coordinates
        cells, counted = np.unique(np.searchsorted(met, a[rest]) * len(met) + np.searchsorted(met, b[rest]), return_counts=True)
        out_a.append(met[cells // len(met)])
        out_b.append(met[cells % len(met)])
        out_n.append(counted)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)


def _bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def encode(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The texts of ``docs`` (text, lang) in blocks: places in the block's own words, which are listed with their counts; -1 ends a piece."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        pending: dict[str, tuple[Places, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal block
            places, parts = pending.pop(lang)
            codes, words = np.concatenate(parts), [w.decode() for w in places][1:]
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            block += 1
            row = [pa.array([lang]), pa.array([block]), pa.array([counts.sum()]), pa.array([words], pa.list_(pa.string()))]
            row += [pa.array([to_planes(counts)], pa.binary()), pa.array([to_planes(codes)], pa.binary())]
            del sizes[lang]
            return pa.RecordBatch.from_arrays(row, ["lang", "block", "size", "words", "counts", "codes"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for row, lang in enumerate(langs):
                tokens = texts[row].as_py().lower().translate(SPLIT).replace(b".", b" . ").split()
                tokens.append(b".")
                places, parts = pending.setdefault(lang, (Places(), []))
                parts.append(np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens)))
                sizes[lang] = sizes.get(lang, 0) + len(tokens)
                if sizes[lang] >= block_words or sum(sizes.values()) >= 3 * block_words:
                    yield flush(max(sizes, key=lambda x: (sizes[x], x)))
        for lang in sorted(pending):
            yield flush(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), text_or_empty("text").alias("text")).mapInArrow(run, BLOCKS)


def _dealt(own: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[list[bytes]], np.ndarray, list[tuple[int, int]]]:
    """The buckets met, each column's part of every bucket, and the order and edges that made them."""
    order = np.argsort(own, kind="stable")
    own = own[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))).tolist()
    edges = list(zip(starts, [*starts[1:], len(own)]))
    return own[starts].tolist(), [[to_planes(c[order[x:y]]) for x, y in edges] for c in columns], order, edges


def _deal_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's words and their counts, by language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, block, words = (batch.column(c)[row].as_py() for c in range(3))
                if not words:
                    continue
                own = np.array([zlib.crc32(w.encode()) for w in words], np.int64) % buckets
                met, (places, counts), order, edges = _dealt(own, [np.arange(len(words)), from_planes(batch.column(3)[row].as_py())])
                parts = [[words[i] for i in order[x:y].tolist()] for x, y in edges]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(met)), pa.array(met, pa.int32()), pa.array([block] * len(met)), pa.array(parts, pa.list_(pa.string())), *(pa.array(c, pa.binary()) for c in (places, counts))],
                    ["lang", "bucket", "block", "words", "places", "n"],
                )

    return blocks.select("lang", "block", "words", "counts").mapInArrow(run, DEALT_WORDS)


def _deal_pairs(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's counted pairs, by language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, block = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                a, b, n = count_pairs(from_planes(batch.column(2)[row].as_py()))
                if not len(a):
                    continue
                order = np.lexsort((b, a))
                a, b, n = a[order], b[order], n[order]
                met, parts, _, _ = _dealt(_bucket(a, b, buckets), [a, b, n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(met)), pa.array(met, pa.int32()), pa.array([block] * len(met)), *(pa.array(c, pa.binary()) for c in parts)],
                    ["lang", "bucket", "block", "a", "b", "n"],
                )

    return blocks.select("lang", "block", "codes").mapInArrow(run, DEALT_PAIRS)


def _answers(table: pa.Table, owner: np.ndarray, ids: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """For each of the bucket's blocks that has frequent entries: the entries' columns and ids."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    blocks = table.column("block").to_pylist()
    edges = np.searchsorted(owner, np.arange(len(blocks) + 1)).tolist()
    told = [c[order] for c in (*columns, ids)]
    return [(blocks[i], to_planes(np.concatenate([c[x:y] for c in told]))) for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]


def _table(table: pa.Table, answers: list[tuple[int, bytes]], ids: np.ndarray, sums: np.ndarray, **lists) -> pa.Table:
    """A row of the bucket's frequent entries (block null), and its answers."""
    rest = len(answers)
    longs = {name: pa.array([lists[name], *[None] * rest] if name in lists else [None] * (rest + 1), pa.list_(pa.int64())) for name in ("a", "b")}
    word = pa.array([lists["word"], *[None] * rest] if "word" in lists else [None] * (rest + 1), pa.list_(pa.string()))
    return pa.table(
        [
            pa.array([table.column("lang")[0].as_py()] * (rest + 1)), pa.array([None, *(x for x, _ in answers)], pa.int64()), pa.array([None, *(x for _, x in answers)], pa.binary()),
            pa.array([ids, *[None] * rest], pa.list_(pa.int64())), pa.array([sums, *[None] * rest], pa.list_(pa.int64())), word, longs["a"], longs["b"],
        ],
        names=["lang", "block", "told", "id", "n", "word", "a", "b"],
    )


def _sum_words(least: int, buckets: int):
    def total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        drop_caches("collocations")
        words = table.column("words").combine_chunks()
        flat = words.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        places, n = (np.concatenate([from_planes(raw) for raw in table.column(c).to_pylist()]) for c in ("places", "n"))
        owner = np.repeat(np.arange(table.num_rows), np.diff(words.offsets.to_numpy()))
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, codes, n)
        often = sorted(np.flatnonzero(sums >= least).tolist(), key=lambda i: (-sums[i], names[i]))
        ids = np.full(len(names), -1)
        ids[often] = np.arange(len(often)) * buckets + int(key[1].as_py())
        kept = ids[codes] >= 0
        answers = _answers(table, owner[kept], ids[codes[kept]], [places[kept]])
        return _table(table, answers, ids[often], sums[often], word=[names[i] for i in often])

    return total


def _sum_pairs(least: int, buckets: int):
    def total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        drop_caches("collocations")
        parts = [[from_planes(raw) for raw in table.column(c).to_pylist()] for c in ("a", "b", "n")]
        owner = np.repeat(np.arange(table.num_rows), [len(x) for x in parts[0]])
        a, b, n = (np.concatenate(x) for x in parts)
        order = np.lexsort((b, a))
        a, b, n, owner = a[order], b[order], n[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        sums = np.add.reduceat(n, starts)
        often = np.flatnonzero(sums >= least)
        often = often[np.lexsort((b[starts[often]], a[starts[often]], -sums[often]))]
        ids = np.full(len(sums), -1)
        ids[often] = np.arange(len(often)) * buckets + int(key[1].as_py())
        each = np.repeat(ids, np.diff(np.append(starts, len(a))))
        kept = each >= 0
        answers = _answers(table, owner[kept], each[kept], [a[kept], b[kept]])
        return _table(table, answers, ids[often], sums[often], a=a[starts[often]], b=b[starts[often]])

    return total


def _renumber(keys: int):
    """Blocks' codes from the buckets' answers: places to ids (one key), or pairs of ids to the ids of the places where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                codes = from_planes(batch.column(2)[row].as_py())
                told = np.concatenate([from_planes(raw).reshape(keys + 1, -1) for raw in batch.column(3)[row].as_py()], axis=1)
                ids = told[-1]
                if keys == 2:
                    met = np.unique(told[:2])
                    known = np.isin(codes, met)
                    place = np.where(known, np.searchsorted(met, np.where(known, codes, met[0])), -1)
                    key = np.searchsorted(met, told[0]) * len(met) + np.searchsorted(met, told[1])
                    order = np.argsort(key)
                    key, ids = key[order], ids[order]
                    x, y = place[:-1], place[1:]
                    wanted = np.where((x >= 0) & (y >= 0), x * len(met) + y, -1)
                    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                    codes = np.where(key[at] == wanted, ids[at], -1)
                else:
                    by_place = np.full(int(codes.max(initial=-1)) + 2, -1)
                    by_place[told[0]] = ids
                    codes = by_place[codes]  # -1 takes the last, which is -1
                # One gap stands for many.
                keep = np.ones(len(codes), bool)
                keep[1:] = (codes[1:] >= 0) | (codes[:-1] >= 0)
                out.append(to_planes(codes[keep]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "block", "codes"])

    return run


def levels(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """All words' number by language (lang, total), and one table a phrase length: (lang, id, n, word) for
    words, (lang, id, n, a, b) for longer phrases, where a and b are the ids of the phrase without its last and first word."""
    blocks = cut(encode(docs, block_words), "phrase-blocks")
    totals = cut(blocks.groupBy("lang").agg(F.sum("size").alias("total")), "phrase-totals")
    all_words = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(all_words / bucket_words))

    found, dealt, total, names = [], _deal_words(blocks, buckets), _sum_words(least, buckets), ["word"]
    for size in range(1, most_words + 1):
        summed = cut(dealt.groupBy("lang", "bucket").applyInArrow(total, SUMMED), f"phrase-sums-{size}")
        of = summed.where("block IS NULL").select("lang", F.explode(F.arrays_zip("id", "n", *names)).alias("of"))
        found.append(cut(of.select("lang", "of.*"), f"phrases-{size}"))
        if size == most_words or found[-1].isEmpty():
            break
        answers = summed.where("block IS NOT NULL").groupBy("lang", "block").agg(F.collect_list("told").alias("told"))  # no more than the block holds
        numbered = blocks.select("lang", "block", "codes").join(answers, ["lang", "block"]).select("lang", "block", "codes", "told")
        blocks = cut(numbered.mapInArrow(_renumber(len(names)), "lang string, block long, codes binary"), f"phrase-codes-{size}")
        dealt, total, names = _deal_pairs(blocks, buckets), _sum_pairs(least, buckets), ["a", "b"]
    return totals, found


def _spelled(found: list[DataFrame]) -> list[DataFrame]:
    """(lang, id, n, phrase, last, a, b) of every level: the words of each phrase and its last word."""
    none = F.lit(None).cast("long")
    out = [found[0].select("lang", "id", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("a"), none.alias("b"))]
    for size, level in enumerate(found[1:], 2):
        head = out[-1].select("lang", F.col("id").alias("a"), F.col("phrase").alias("head"))
        tail = out[-1].select("lang", F.col("id").alias("b"), "last")
        spelled = level.join(head, ["lang", "a"]).join(tail, ["lang", "b"])
        out.append(cut(spelled.select("lang", "id", "n", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "b"), f"spelled-{size}"))
    return out


def score_of() -> Column:
    """floor(1000 a n / (l r)) of the columns a, n, l, r, exact where the products pass 64 bits."""
    wide = {c: F.col(c).cast("decimal(17,0)") for c in "anlr"}
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])


def mine_phrases(
    docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int | None = TOP, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` candidates of every language (all of them for None)
    by score, then a (both descending), then phrase in byte order."""
    totals, found = levels(docs, least, most_words, block_words, bucket_words)
    spelled = _spelled(found)
    parts = spelled[0].select("lang", "phrase", "n")
    for level in spelled[1:-1]:
        parts = parts.unionByName(level.select("lang", "phrase", "n"))
    candidates = None
    for size, level in enumerate(spelled[1:], 2):
        kept = level.select("lang", "id", "phrase", F.col("n").alias("a"))
        if size < len(spelled):
            longer = spelled[size].select("lang", F.explode(F.array("a", "b")).alias("id"), "n").groupBy("lang", "id").agg(F.max("n").alias("most"))
            kept = kept.join(longer, ["lang", "id"], "left").where("most IS NULL OR most < a")
        cuts = F.array(
            *[F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("head"), F.substring_index("phrase", " ", k - size).alias("tail")) for k in range(1, size)]
        )
        kept = kept.select("lang", "phrase", "a", F.explode(cuts).alias("cut"))
        candidates = kept if candidates is None else candidates.unionByName(kept)
    spark = docs.sparkSession
    if candidates is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    candidates = cut(candidates.select("lang", "phrase", "a", "cut.*"), "phrase-cuts")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = candidates.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals.withColumnRenamed("total", "n"), "lang")
    scored = scored.withColumn("score", score_of())
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("of")).select("lang", "phrase", "of.*")
    order = (F.desc("score"), F.desc("a"), "phrase")
    if top is not None:  # a language's candidates are cut in parts first, so its last window gets no more than the parts' first ones
        part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
        lowest = lowest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("place", part).where(F.col("place") <= top)
    best = lowest.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = best.where(F.col("place") <= top) if top is not None else best
    return best.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
