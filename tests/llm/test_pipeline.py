"""Each stage of the corpus pipeline against a brute-force version of it, stage after stage."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lakeaudit.llm import line_dedup, packing, quality, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w) or text or ""}


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def brute_good(rows, spark):
    """The scorer run outside Spark, with weights fitted on the rows of least hash."""
    patterns = []
    for _, text, *_ in rows:
        places = quality._tokens.look_up(text or "")
        patterns.append(sum(v * 3**i for i, v in enumerate(quality.votes(places, quality._tokens.facts))) if len(places) else -1)
    counts = collections.Counter(p for p in patterns if p >= 0)
    model = quality.WeakLabels(np.array(sorted(counts)), np.array([counts[p] for p in sorted(counts)], float))
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").withColumn("order", F.xxhash64("doc_id", "text"))
    order = [r.text for r in frame.where(F.col("text").rlike(r"\S")).orderBy("order", "text").limit(quality.FIT_ROWS).collect()]
    ids, shares, soft = [], [], []
    for text in order:
        places = quality._tokens.look_up(text)
        at, count = np.unique(quality._features(places), return_counts=True)
        ids.append(at)
        shares.append(count * 100.0 / max(len(places), quality.SHORT))
        soft.append(model.posterior(np.array([sum(v * 3**i for i, v in enumerate(quality.votes(places, quality._tokens.facts)))]))[0])
    weights, bias = quality.fit_scorer(ids, shares, np.array(soft))
    labels = model.posterior(np.arange(3 ** len(quality.LABELLERS)))
    scores = quality._scores([r[1] or "" for r in rows], weights, bias, labels)[:, 1]
    return [r for r, s in zip(rows, scores) if s <= quality.REJECT]


def brute_lines(rows):
    fold = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda line: line.strip(line_dedup.BLANKS).translate(fold)
    seen = collections.Counter(k for _, text, *_ in rows for k in {key(line) for line in (text or "").split("\n")})
    out = []
    for doc, text, lang, source, _ in rows:
        kept = "\n".join(line for line in (text or "").split("\n") if not key(line) or seen[key(line)] < 10)
        out.append((doc, kept, lang, source, len(kept)))
    return out


def brute_one_of_each(rows):
    """One row of each component of Jaccard similarity 0.8 or more: that of the least doc_id."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {min((rows[i][0], i) for i in range(len(rows)) if find(i) == r)[1] for r in set(map(find, range(len(rows))))}


def test_stages_equal_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(docs)
    columns = docs.columns

    def after(name):
        nonlocal docs
        docs = stages[name](spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        return rows_of(docs)

    good = after("quality classifier")
    assert sorted(good) == sorted(brute_good(rows, spark)) and 0 < len(good) < len(rows)
    cleaned = after("line dedup")
    assert sorted(cleaned) == sorted(brute_lines(good)) and sorted(cleaned) != sorted(good)
    single = after("n-gram Jaccard join")
    assert sorted(single) == sorted(cleaned[i] for i in brute_one_of_each(cleaned)) and len(single) < len(cleaned)
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 5]
    fresh = after("benchmark decontamination")
    assert sorted(fresh) == sorted(r for r in single if not any(len(shingles(r[1]) & x) >= 0.8 * len(x) for x in items))

    from tokenizers import Tokenizer

    library, expected = Tokenizer.from_file(queries.tokenizer_path()), collections.Counter()
    for doc, text, *_ in fresh:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            own = np.array(ids[at : at + packing.CAPACITY], "<u4").tobytes()
            expected[doc, piece, at, len(own) // 4, zlib.crc32(own)] += 1
    packed = corpus_pipeline.run(spark, SF).collect()  # all stages in one go
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= packing.CAPACITY
    least = -(-sum(r.length for r in packed) // packing.CAPACITY)
    assert len(places) <= least + 1


def test_own_columns_named_like_the_counts_stay(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"the same line\nline {i}", 100 + i, "x") for i in range(12)], "doc_id long, text string, n_lines int, n_dropped string")
    got = corpus_pipeline.lines(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted((i, f"line {i}", 100 + i, "x") for i in range(12))
