"""Periodic run detection by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(least, 3 * q)`` that no neighbouring word extends with that period. On the diagonal of
lag q (words i and i + q) such a run matches over at least ``max(least - q, 2 * q)`` words, the
guaranteed overlap; its minimum over all q is ``seed``, two thirds of ``least``.

Seeds: lags are taken in classes (Q, 1.5 Q], each with k-grams of k = 2 Q words, which is at
most the guaranteed overlap of every lag of the class (the first class is 1 to seed / 2). So both ends of
the lag lie in one run as occurrences of one k-gram. Two occurrences at most Q / 2 apart would
give the k-gram a period that divides q (Fine and Wilf), so q is one of the next two
occurrences; pairing each occurrence with these two finds every run, and no k-gram of many
occurrences gives all its pairs. Only words whose seed-gram occurs again in its document take part.

Extension: a seed is extended both ways by comparing words, unless the furthest-covered table
of its document and lag shows that it lies on a stretch that was extended before. Hashes only
propose seeds; every run rests on compared words. Of runs with one stretch the smallest period stays.

Words are maximal runs of characters other than ASCII white space. A task reads documents
in slices of about ``SLICE_WORDS`` words; one longer document is a slice of its own, so a task's
memory follows its longest document. Nothing is shuffled: rows never meet.

Defined cases: null and empty texts and texts of white space have no words, no runs and an empty
collapsed text; rows with null or repeated ids are judged one by one; other input columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import bind, importable, text_or_empty

LEAST, TIMES = 24, 3
SLICE_WORDS = 200_000
WORDS = r"[^\x20\x09-\x0D]+"
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


def _matching(ids: np.ndarray, left: int, right: int, most: int) -> int:
    """How many words from ``left`` and from ``right`` on are equal, ``most`` at most."""
    done, block = 0, 64
    while done < most:
        take = min(block, most - done)
        differs = ids[left + done : left + done + take] != ids[right + done : right + done + take]
        if differs.any():
            return done + int(differs.argmax())
        done += take
        block *= 2
    return most


def _matching_before(ids: np.ndarray, left: int, right: int, most: int) -> int:
    """The same for the words before ``left`` and ``right``."""
    done, block = 0, 64
    while done < most:
        take = min(block, most - done)
        differs = (ids[left - done - take : left - done] != ids[right - done - take : right - done])[::-1]
        if differs.any():
            return done + int(differs.argmax())
        done += take
        block *= 2
    return most


class _Grams:
    """Hashes of the k-grams that start at every word; grams that would leave a document are left out by the callers."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray):
        self.own = _mixed((owner.astype(np.uint64) + np.uint64(1)) * _B)
        self.powers = [_mixed(ids.astype(np.uint64) * _A + _B)]

    def of(self, k: int) -> np.ndarray:
        """One hash for each start up to len - k, which depends on the document as well."""
        top = k.bit_length() - 1
        while len(self.powers) <= top:
            last, m = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(_mixed(last[: len(last) - m] * _A + (last[m:] ^ _B) * _C))
        part, m = self.powers[top], 1 << top
        count = len(self.own) - k + 1
        return _mixed(part[:count] * _C + (part[k - m : k - m + count] ^ _A) * _B) ^ self.own[:count]


def _again(hashed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` ordered by gram and place, and whether each is followed by the same gram."""
    order = starts[np.argsort(hashed[starts], kind="stable")]
    own = hashed[order]
    return order, own[:-1] == own[1:]


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document that has any, by start and period.

    ``ids`` numbers the words of all documents of a slice; document d has those from ``bounds[d]`` to ``bounds[d + 1]``.
    """
    seed = -(-2 * least // 3)
    if len(ids) < seed:
        return {}
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashed = _Grams(ids, owner).of(seed)
    inside = np.flatnonzero(bounds[1:][owner[: len(hashed)]] - np.arange(len(hashed)) >= seed)
    order, same = _again(hashed, inside)
    repeated = np.zeros(len(ids), bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    taken = np.unique(owner[repeated])
    if not len(taken):
        return {}

    # From here on only the documents with a repeated seed.
    chosen = np.zeros(len(sizes), bool)
    chosen[taken] = True
    mask = np.repeat(chosen, sizes)
    ids, repeated, owner = ids[mask], repeated[mask], np.repeat(np.arange(len(taken)), sizes[taken])
    begins = np.concatenate(([0], np.cumsum(sizes[taken])))
    ends = begins[1:][owner]
    gaps = np.append(np.flatnonzero(~repeated), len(ids))
    here = np.arange(len(ids))
    streak = gaps[np.searchsorted(gaps, here)] - here  # repeated seeds from here on without a gap
    grams = _Grams(ids, owner)
    found: dict[int, dict[tuple[int, int], int]] = {}
    longest = int(sizes[taken].max()) // TIMES
    low, high, k = 0, seed // 2, seed
    while low < longest:
        covered: dict[tuple[int, int], int] = {}
        starts = np.flatnonzero((streak >= k - seed + 1) & (ends - here >= k))
        if len(starts) > 1:
            order, same = _again(grams.of(k), starts)
            first = [order[:-1][same]]
            lag = [order[1:][same] - first[0]]
            twice = same[:-1] & same[1:]
            first.append(order[:-2][twice])
            lag.append(order[2:][twice] - first[1])
            at, lags = np.concatenate(first), np.concatenate(lag)
            keep = (lags > low) & (lags <= high)
            at, lags = at[keep], lags[keep]
            order = np.lexsort((at, lags))
            at, lags = at[order], lags[order]
            head = np.ones(len(at), bool)  # later seeds of a stretch follow word by word
            head[1:] = (lags[1:] != lags[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            for i, q in zip(at[head].tolist(), lags[head].tolist()):
                doc = int(owner[i])
                if i < covered.get((doc, q), -1):
                    continue
                begin, end = int(begins[doc]), int(begins[doc + 1])
                start = i - _matching_before(ids, i, i + q, i - begin)
                last = i + _matching(ids, i, i + q, end - i - q)
                covered[doc, q] = last
                length = last - start + q
                if length >= max(least, TIMES * q):
                    stretch = (start - begin, length)
                    own = found.setdefault(int(taken[doc]), {})
                    own[stretch] = min(q, own.get(stretch, q))
        low, high, k = high, high + max(1, high // 2), 2 * high
    return {doc: sorted((start, length, q) for (start, length), q in own.items()) for doc, own in found.items()}


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > SLICE_WORDS:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; the start counts words from 0) and collapsed for every row of ``docs``.

    ``collapsed`` holds the words, joined by single spaces, without those that a run contains after its first period.
    """
    if least < 6:
        raise ValueError("least must be 6 or more")
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ahead = 0
            while ahead < batch.num_rows:  # a few texts at a time are split into words
                upto, size = ahead, 0
                while upto < batch.num_rows and (upto == ahead or size < 8 * SLICE_WORDS):
                    size += len(texts[upto].as_buffer())
                    upto += 1
                split = [t.split() for t in texts.slice(ahead, upto - ahead).to_pylist()]  # of bytes: at ASCII white space only
                for begin, end in _slices([len(words) for words in split]):
                    part = split[begin:end]
                    bounds = np.concatenate(([0], np.cumsum([len(words) for words in part]))).astype(np.int64)
                    flat = pa.array([w for words in part for w in words], pa.binary()).dictionary_encode()
                    found = runs_of(flat.indices.to_numpy(), bounds, least)
                    kept = [b" ".join(kept_words(words, found[d]) if d in found else words) for d, words in enumerate(part)]
                    rows = [[dict(zip(("start", "length", "period"), r)) for r in found.get(d, ())] for d in range(len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(ahead + begin, end - begin), pa.array(np.diff(bounds)), pa.array(rows, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "runs", "collapsed"],
                    )
                ahead = upto

    return docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")).mapInArrow(run, RUNS)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties to the smallest start, then period. Null if there is none."""

    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        ahead = (left > right) | ((left == right) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        same = (left == right) & (a["start"] == b["start"]) & (a["period"] == b["period"])
        return F.when(same, 0).when(ahead, -1).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the stated periodic tail in the documents whose crc32 ends in 0; null ids have none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / F.lit(10)).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        return F.when(n == 0, F.lit("")).otherwise(
            bind(
                F.struct(a.alias("a"), p.alias("p")),
                lambda at: F.array_join(
                    F.transform(words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, (at["a"] + F.pmod(i - at["a"], at["p"])).cast("int")))),
                    " ",
                ),
            )
        )

    words = F.regexp_extract_all(text_or_empty("text"), F.lit(f"({WORDS})"), F.lit(1))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, bind(words, repeated)).otherwise(F.col("text")).alias("text"))
