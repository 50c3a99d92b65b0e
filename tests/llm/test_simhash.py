"""Fingerprints, ball links and components against brute force, and the defined cases."""

from __future__ import annotations

import math
import os
import re
import uuid
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeaudit.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [words[i : i + n] for i in range(len(words) - n + 1)] if len(words) >= n else [words] * bool(words)
    hashed = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(codes, radius=4):
    """The root (least position) of every value, from all pairs."""
    codes = np.array(codes, np.uint64)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def check(rows, got):
    """``rows``: (doc_id, text); ``got``: the operator's rows."""
    codes = [brute_fingerprint(text) for _, text in rows]
    roots = brute_components(codes)
    least = {}
    for (doc, _), root in zip(rows, roots):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    expected = Counter((doc, f"{code:016x}", least.get(root)) for (doc, _), code, root in zip(rows, codes, roots))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_simhash(spark, SF).collect()
    check(rows, got)
    assert any(r.component_id != r.doc_id for r in got)


@pytest.mark.parametrize("radius,variants", [(4, simhash.VARIANTS), (4, 3_000), (2, 500)])
def test_links_equal_brute_force_also_where_one_ball_holds_a_third(spark, radius, variants):
    """Small buckets make the group of near copies split over several rounds."""
    rng = np.random.default_rng(radius + variants)
    flipped = lambda code, k: int(code) ^ sum(1 << int(p) for p in rng.choice(64, k, replace=False))
    far = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    chains = [flipped(code, int(rng.integers(1, 7))) for code in far[:150]]
    centre = far[0]
    ball = [flipped(centre, int(rng.integers(0, 4))) for _ in range(250)]
    codes = sorted({*far, *chains, *ball, 0, 2**64 - 1, 1, 2**63})
    table = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fingerprint long")
    edges = simhash.ball_links(table, radius, variants).collect()
    place = {simhash._signed(c): i for i, c in enumerate(codes)}
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ((find(place[e.a]), find(place[e.b])) for e in edges):
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(codes))] == brute_components(codes, radius)


def test_a_large_ball_is_dealt_out(spark, monkeypatch, tmp_path):
    """A third of all fingerprints in one ball: no bucket makes over twice the stated variants."""
    rng = np.random.default_rng(1)
    codes = {int(x) for x in rng.integers(0, 2**64, 400, dtype=np.uint64)} | {(1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (200, 2))}
    table = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fingerprint long")
    meet, folder = simhash._meet, str(tmp_path)

    def counted(radius):
        own = meet(radius)

        def run(group):
            free = bin(group.column("free")[0].as_py() & (1 << 64) - 1).count("1")
            made = sum(math.comb(free, k) for left in group.column("left").to_pylist() for k in range(left + 1))
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(f"{group.num_rows} {made}")
            return own(group)

        return run

    monkeypatch.setattr(simhash, "_meet", counted)
    simhash.ball_links(table, 4, 2_000).collect()
    met = [tuple(map(int, (tmp_path / name).read_text().split())) for name in os.listdir(folder)]
    assert max(made for _, made in met) <= 4_000
    assert sum(rows for rows, _ in met) > 10 * max(rows for rows, _ in met)


def test_long_text_counts_in_blocks(spark, monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(250_000))
    got = simhash.fingerprints(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {1: simhash._signed(brute_fingerprint(text)), 2: 0}


def test_defined_cases(spark):
    words = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, None), (2, ""), (3, " \n\t\x0b"), (4, "one two"), (5, "ONE two"), (6, "ÀB c d e"), (6, "àb c d e"), (None, "one\ntwo"), (None, None),
        (None, "alone here"), (8, words), (7, words), (7, words), (9, words + " end"), (10, "\x1c \xa0"),
    ]
    docs = spark.createDataFrame([(a, b, 7, "x") for a, b in rows], "doc_id long, text string, bucket int, fingerprint string")
    check(rows, simhash.near_components(docs).collect())
    assert simhash.near_components(docs.limit(0)).collect() == []
    only = simhash.near_components(docs.where(F.col("doc_id").isNull() & (F.col("text") == "alone here"))).collect()
    assert [(r.doc_id, r.component_id) for r in only] == [(None, None)]
