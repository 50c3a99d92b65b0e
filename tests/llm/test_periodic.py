"""Periodic runs against brute force over every lag, and the defined cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lakeaudit.llm import queries
from lakeaudit.llm.periodic import find_runs, runs_of, with_repeats

SF = "/root/testdata/sf0.001"


def brute(words, least=24):
    """Every maximal match of words q apart; of one stretch the smallest q."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 3 * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, n_, q) for (s, n_), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng):
    letters, out = rng.choice([1, 2, 2, 3, 50]), []
    while len(out) < rng.integers(0, 400):
        unit = rng.integers(0, letters, rng.integers(1, rng.choice([4, 12, 40, 60]))).tolist()
        if rng.random() < 0.4:  # periods made of smaller ones
            unit = unit * int(rng.integers(1, 4)) + unit[: int(rng.integers(0, 3))]
        out += (unit * int(rng.integers(1, 6)))[: int(rng.integers(1, len(unit) * 5 + 1))] or unit
    return out


@pytest.mark.parametrize("least", [24, 25, 9])
def test_runs_equal_brute_force(least):
    rng, met = np.random.default_rng(least), 0
    for _ in range(40):
        docs = [periodic_words(rng) for _ in range(8)]
        ids = np.array([w for d in docs for w in d], np.int64)
        got = runs_of(ids, np.concatenate(([0], np.cumsum([len(d) for d in docs]))), least)
        for d, words in enumerate(docs):
            assert got.get(d, []) == brute(words, least)
            met += len(got.get(d, []))
    assert met > 100


def test_runs_of_one_word_and_of_one_line_stay_linear():
    n = 300_000
    assert runs_of(np.zeros(n, np.int64), np.array([0, n])) == {0: [(0, n, 1)]}
    assert runs_of(np.arange(n) % 20, np.array([0, n])) == {0: [(0, n, 20)]}


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_periodic(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_runs for r in got) > 5
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)


def test_defined_cases(spark):
    line = " ".join(f"w{i}" for i in range(9))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, " ".join([line] * 3)), (4, " ".join([line] * 3)), (None, "a " * 23), (None, "a\n" * 24),
        (5, "a\xa0a " * 30), (6, "\x1ca \x1ca " * 12), (7, " ".join([line] * 20_000)),
    ]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, runs long, collapsed string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect()))
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 27, [(0, 27, 9)], line), (4, 27, [(0, 27, 9)], line),
        (0, 23, [], " ".join("a" * 23)), (0, 24, [(0, 24, 1)], "a"), (5, 30, [(0, 30, 1)], "a\xa0a"),
        (6, 24, [(0, 24, 1)], "\x1ca"), (7, 180_000, [(0, 180_000, 9)], line),
    ])
    assert find_runs(docs.limit(0)).collect() == []
    assert {r.text for r in with_repeats(docs.where("doc_id IS NULL")).collect()} == {"a " * 23, "a\n" * 24}
