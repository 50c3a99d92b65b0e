"""Phrases against brute force, also in small blocks and buckets, and the defined cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakeaudit.llm import collocations
from lakeaudit.llm.collocations import count_pairs, from_planes, mine_phrases, to_planes

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for m in range(1, most + 1):
                counts[lang].update(words[i : i + m] for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n, found, hidden = totals[lang], [], set()
        often = {g: c for g, c in f.items() if c >= least and len(g) > 1}
        for g, c in often.items():
            for m in range(2, len(g)):
                hidden |= {part for i in range(len(g) - m + 1) if 100 * c >= 100 * f[part := g[i : i + m]]}
        for g, a in often.items():
            if g not in hidden:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def listed(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("least,top,block,bucket", [(3, 300, 5_000, 20_000), (8, None, 1_000_000, 2_000_000)])
def test_phrases_equal_brute_force(spark, least, top, block, bucket):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    expected = brute(rows, least, top=top or 10**9)
    assert len(expected) > 50 and {len(p[2].split(" ")) for p in expected} >= {2, 3, 4, 5}
    assert listed(mine_phrases(docs, least, top=top, block_words=block, bucket_words=bucket)) == expected


def test_pairs_by_direct_address_and_sorted_coordinates():
    rng = np.random.default_rng(3)
    codes = np.minimum(rng.geometric(0.01, 60_000) - 2, 3_000)
    codes[rng.random(len(codes)) < 0.05] = 2**40
    expected = Counter((int(x), int(y)) for x, y in zip(codes, codes[1:]) if x >= 0 and y >= 0)
    for dense in (0.0, 1 / 16, 9.0):
        a, b, n = count_pairs(codes, 64, dense)
        assert {(int(x), int(y)): int(z) for x, y, z in zip(a, b, n)} == expected and len(a) == len(expected)
    assert (from_planes(to_planes(codes)) == codes).all()
    assert all(len(x) == 0 for x in count_pairs(np.array([-1, 5, -1, 7])))


@pytest.mark.parametrize("bucket", [6_000, 10**9])
def test_ids_follow_frequency(spark, bucket):
    """Ids are unique, and ranked by frequency in each bucket; over one bucket they are the ranks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    totals, found = collocations.levels(docs, 5, 2, bucket_words=bucket)
    for level in found:
        rows = [(r.lang, r.id, r.n) for r in level.collect()]
        assert len({x[:2] for x in rows}) == len(rows) > 100
        for lang in {x[0] for x in rows}:
            own = sorted((i, n) for x, i, n in rows if x == lang)
            if bucket == 10**9:
                assert [i for i, _ in own] == list(range(len(own))) and [n for _, n in own] == sorted((n for _, n in own), reverse=True)
            else:  # the first tenth holds the most frequent
                assert sum(n for _, n in own[: len(own) // 10 + 1]) >= 0.5 * sum(sorted((n for _, n in own), reverse=True)[: len(own) // 10 + 1])


def test_hot_pair_and_defined_cases(spark):
    """One pair holds over a third of all rows; odd rows count as stated."""
    rows = [(1, "x y", None), (None, "x y", "und"), (1, "x y", "und"), (2, None, "en"), (3, "", None), (4, "\n.;", "en"), (5, "X\tY. x y\x0bz \x1c z", "und"), (6, "é É é É", "fr")]
    rows += [(7, "hot pair " * 2_000, "en")] * 3 + [(8, "a b c d e f " * 5_000, "en")]
    docs = spark.createDataFrame([(a, b, c, 1, "w") for a, b, c in rows], "doc_id long, text string, lang string, n long, word string")
    got = listed(mine_phrases(docs, 2, block_words=3_000, bucket_words=1_000))
    assert got == brute([(c, b) for _, b, c in rows], 2)
    assert listed(mine_phrases(docs.limit(0))) == [] and listed(mine_phrases(docs.where("doc_id = 2"))) == []


def test_exact_beyond_64_bits(spark):
    """The scores' products are decimals; checked through the expression on stated counts."""
    from pyspark.sql import functions as F

    rows = [(10**12 + 7, 10**13 + 9, 10**12 + 11, 10**12 + 13), (3, 10**15, 3, 3)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", collocations.score_of().alias("score"))
    assert [r.score for r in df.collect()] == [1000 * a * n // (left * r) for a, n, left, r in rows]
