"""Removal of repeated byte strings by column-wise multi-document construction.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else.

1. Anchors. Of every ``LENGTH`` bytes the position whose ``GRAM``-byte hash is least (the
   rightmost of equals) is an anchor. The choice depends on those bytes alone, so two
   equal strings have anchors with equal hashes at the same offset: no repeat is missed.
   Where strings repeat inside one document, only their first places make anchors, and
   all their places are recorded at once (so runs of one word do not make an anchor a byte).
2. Windows. The bytes around an anchor that any such string can reach, ``LENGTH`` less
   ``GRAM`` to its left and ``LENGTH`` to its right, are its window. Anchors with equal hash
   and equal window are one class, counted with a combine before the shuffle. A class of
   two or more is repeated throughout; one row of it is enough to compare it with others.
3. Column-wise construction. The windows of one hash are aligned at their anchors. Each
   round inserts one symbol of every window, from the last column to the first, and updates
   the order of the suffixes (the collection's Burrows-Wheeler order in that column) and
   the common prefix lengths of neighbours: a stable sort by the new symbol, and one more
   than the least length between two neighbours with the same symbol. After a column's
   round, a suffix whose common prefix with a neighbour reaches ``LENGTH`` is repeated.
   As equal strings stand in equal columns, no other suffixes need comparing, and the state
   is one row per window instead of all suffixes seen so far. A task's state is bounded
   (``TASK_WINDOWS`` windows) and lives in arrays; sorted shuffle files take the place of
   files written each round.
4. A hash with more than ``GROUP_WINDOWS`` different windows is not one group: the hashes of
   all its windows' strings, by column, are counted by Spark instead (exact as well).
5. The repeated ranges of each class go to its rows, and each text is cut once.

Defined cases: null and empty texts have no bytes; texts under ``LENGTH`` bytes lose
nothing; repeated rows are copies of each other (each place of one is a place elsewhere);
bytes are cut wherever a range ends, also inside a character, so the kept bytes are binary;
null ids stay null; an empty table gives no rows; other input columns are ignored. One
document is worked on in memory as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, importable

LENGTH, GRAM = 400, 64
GROUP_WINDOWS, TASK_WINDOWS = 20_000, 20_000
SLICE_BYTES = 1 << 21

ANCHORS = "r1 long, r2 long, h long, w long, pos int, lo int, hi int, stop int"
WINDOWS = "h long, w long, lo int, bytes binary"
RANGES = "h long, w long, ranges array<struct<s: int, e: int>>"

_rng = np.random.default_rng(400)
SYMBOLS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(2**61, 2**62)) * 2 + 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        tables = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            table = np.empty(size, np.uint64)
            table[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                table[done : done + step] = table[:step] * np.uint64(pow(base, done, 2**64))
                done += step
            tables.append(table)
        _powers[:] = tables
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any range of ``data``, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SYMBOLS[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring keys."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts in ``data`` (text i is bounds[i]:bounds[i+1]) and ranges repeated inside a text.

    Returns (text, hash, window hash, pos, lo, hi) of the anchors and (text, start, end) of the ranges.
    """
    none = np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    if len(data) < LENGTH or not (sizes >= LENGTH).any():
        return (none,) * 9
    rolling = Rolling(data)
    grams = rolling.every(GRAM)
    span, bits = LENGTH - GRAM + 1, np.uint64(28)
    place = np.arange(len(grams), dtype=np.uint64)
    last = np.uint64((1 << 28) - 1)
    chosen = (last - (_least((grams & ~last) | (last - place), span) & last)).astype(np.int64)
    starts = np.concatenate([np.arange(b, b + s - LENGTH + 1) for b, s in zip(bounds, sizes) if s >= LENGTH])
    owner = np.searchsorted(bounds, starts, side="right") - 1
    chosen = chosen[starts]
    keep = np.ones(len(starts), bool)
    keep[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    text, at = owner[keep], chosen[keep]
    # Texts in which two anchors agree may repeat a string inside.
    order = np.lexsort((grams[at], text))
    twice = (grams[at][order][1:] == grams[at][order][:-1]) & (text[order][1:] == text[order][:-1])
    inner: list[tuple[np.ndarray, ...]] = []
    suspects = np.unique(text[order][1:][twice])
    if len(suspects):
        fine = ~np.isin(text, suspects)
        found_text, found_at = [text[fine]], [at[fine]]
        for t in suspects.tolist():
            mine = slice(*np.searchsorted(owner, [t, t + 1]))
            own, own_chosen = starts[mine], chosen[mine]
            strings = rolling.ranges(own, own + LENGTH)
            _, first, back, count = np.unique(strings, return_index=True, return_inverse=True, return_counts=True)
            again = count[back] > 1
            if again.any():
                run = own[again]
                cuts = np.flatnonzero(np.diff(run) > LENGTH) + 1
                begin, end = run[np.concatenate(([0], cuts))], run[np.concatenate((cuts - 1, [len(run) - 1]))] + LENGTH
                inner.append((np.full(len(begin), t), begin - bounds[t], end - bounds[t]))
            picked = np.unique(own_chosen[first])
            found_text.append(np.full(len(picked), t))
            found_at.append(picked)
        text, at = np.concatenate(found_text), np.concatenate(found_at)
    lo = np.maximum(at - (LENGTH - GRAM), bounds[text])
    hi = np.minimum(at + LENGTH, bounds[text + 1])
    window = rolling.ranges(lo, hi) ^ _mixed((at - lo).astype(np.uint64))
    inside = tuple(np.concatenate(c) for c in zip(*inner)) if inner else (none,) * 3
    return (text, grams[at].view(np.int64), window.view(np.int64), at - bounds[text], lo - at, hi - at, *inside)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where its values begin (with the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["r1", "r2", "h", "w", "pos", "lo", "hi", "stop"]
    for batch in batches:
        data, offsets = _buffers(batch.column(2))
        r1, r2 = (batch.column(c).to_numpy() for c in (0, 1))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            bounds = offsets[at : to + 1] - offsets[at]
            text, h, w, pos, lo, hi, inner, start, stop = anchors(data[offsets[at] : offsets[to]], bounds)
            int32 = lambda x: pa.array(x.astype(np.int32))
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r1[at + text]), pa.array(r2[at + text]), pa.array(h), pa.array(w), int32(pos), int32(lo), int32(hi), pa.nulls(len(text), pa.int32())], names
                )
            if len(inner):
                n = len(inner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r1[at + inner]), pa.array(r2[at + inner]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), int32(start), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), int32(stop)], names
                )
            at = to


def columns_repeated(symbols: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For aligned windows (rows; 0 is no symbol, groups ascending): bool [rows, columns], whether the
    ``length`` symbols that start in that column also stand there in another window of the group."""
    rows, width = symbols.shape
    out = np.zeros((rows, width - length + 1), bool)
    order = np.arange(rows)
    common = np.zeros(rows + 1, np.int64)  # of a suffix and the one before it; the last entry is a stop
    rank = group.astype(np.int64) * 512
    by_column = np.ascontiguousarray(symbols.T)
    for column in range(width - 1, -1, -1):
        symbol = by_column[column][order]
        key = rank[order] + symbol
        if (key[1:] >= key[:-1]).all():
            moved = None
            before = np.arange(rows)
        else:
            moved = np.argsort(key, kind="stable")
            before, key, symbol, order = moved, key[moved], symbol[moved], order[moved]
        same = np.zeros(rows, bool)
        same[1:] = (key[1:] == key[:-1]) & (symbol[1:] != 0)
        new = np.zeros(rows + 1, np.int64)
        if moved is None:
            new[:-1][same] = common[:-1][same] + 1
        else:
            here = np.flatnonzero(same)
            left, right = before[here - 1] + 1, before[here] + 1
            if len(here):
                new[here] = np.minimum.reduceat(common, np.stack((left, right), axis=1).ravel())[::2] + 1
        common = new
        if column < out.shape[1]:
            out[order, column] = np.maximum(common[:-1], common[1:]) >= length
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal ranges that strings of ``length`` bytes at ascending ``starts`` cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    begin, end = starts[np.concatenate(([0], cuts))], starts[np.concatenate((cuts - 1, [len(starts) - 1]))] + length
    return list(zip(begin.tolist(), end.tolist()))


def _ranges_table(h, w, ranges) -> pa.Table:
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    return pa.table([pa.array(h, pa.int64()), pa.array(w, pa.int64()), pa.array([[{"s": s, "e": e} for s, e in r] for r in ranges], kind)], names=["h", "w", "ranges"])


def _build(table: pa.Table) -> pa.Table:
    """The construction over the groups of one task."""
    h, w, lo = (table.column(c).to_numpy() for c in ("h", "w", "lo"))
    order = np.lexsort((w, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
    order = order[new]  # repeated rows bring a window again
    raw = table.column("bytes").to_pylist()
    left, width = LENGTH - GRAM, 2 * LENGTH - GRAM
    symbols = np.zeros((len(order), width), np.uint16)
    for row, place in enumerate(order.tolist()):
        begin = left + int(lo[place])
        symbols[row, begin : begin + len(raw[place])] = np.frombuffer(raw[place], np.uint8)
        symbols[row, begin : begin + len(raw[place])] += 1
    _, group = np.unique(h[order], return_inverse=True)
    found = columns_repeated(symbols, group)
    hit = np.flatnonzero(found.any(axis=1))
    return _ranges_table(h[order][hit], w[order][hit], [_runs(np.flatnonzero(found[row]) - left, LENGTH) for row in hit.tolist()])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, w, column, hash of every string of a window."""
    for batch in batches:
        for h, w, lo, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if len(raw) >= LENGTH:
                every = Rolling(np.frombuffer(raw, np.uint8)).every(LENGTH).view(np.int64)
                n = len(every)
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([w] * n, pa.int64()), pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.array(every)], ["h", "w", "at", "string"])


def _cut_texts(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, at, removed, spans = [], 0, 0, 0
                end = None
                for r in sorted((r["s"], r["e"]) for r in ranges or ()):
                    if end is not None and r[0] <= end:
                        end = max(end, r[1])
                        continue
                    if end is not None:
                        kept.append(text[at:begin])
                        removed, spans, at = removed + end - begin, spans + 1, end
                    begin, end = r
                if end is not None:
                    kept.append(text[at:begin])
                    removed, spans, at = removed + end - begin, spans + 1, end
                left = b"".join(kept) + text[at:] if kept or at else text
                for column, value in zip(out, (len(text), removed, spans, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                arrays, names = [*arrays, pa.array(out[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, with_kept: bool = False, group_windows: int = GROUP_WINDOWS, task_windows: int = TASK_WINDOWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) for every row of ``docs``."""
    importable(docs.sparkSession)
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))

    def key(other: bool) -> Column:
        return F.xxhash64(F.lit(7), "doc_id", "text") if other else F.xxhash64("doc_id", "text")

    found = cut(docs.select(key(False), key(True), data.alias("data")).mapInArrow(_scan, ANCHORS), "anchors")
    places = found.where("stop IS NULL")
    classes = places.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "pos", "lo", "hi")).alias("one"))
    classes = cut(classes, "window-classes")
    hashes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("windows")).where("windows > 1")
    hashes = cut(hashes, "compared-hashes")
    compared = cut(classes.join(hashes, "h").select("h", "w", "one.*", "windows"), "compared-windows")
    by_text = compared.groupBy("r1", "r2").agg(F.collect_list(F.struct("h", "w", "pos", "lo", "hi")).alias("places"))
    # A text that stands in the table more than once brings its windows once.
    bytes_of = (
        docs.select(key(False).alias("r1"), key(True).alias("r2"), data.alias("data"))
        .join(by_text, ["r1", "r2"])
        .select("data", F.explode("places").alias("p"))
        .select(
            F.col("p.h").alias("h"), F.col("p.w").alias("w"), F.col("p.lo").alias("lo"),
            F.expr("substring(data, p.pos + p.lo + 1, p.hi - p.lo)").alias("bytes"),
        )
    )
    windows = cut(bytes_of, "windows")
    wide = hashes.where(F.col("windows") > group_windows).select("h")
    wide = cut(wide, "wide-hashes")
    tasks = max(1, -(-compared.count() // task_windows))
    built = (
        windows.join(wide, "h", "left_anti")
        .groupBy(F.pmod(F.xxhash64("h"), F.lit(tasks)).alias("task"))
        .applyInArrow(_build, RANGES)
    )
    strings = windows.join(wide, "h", "left_semi").dropDuplicates(["h", "w"]).mapInArrow(_strings, "h long, w long, at int, string long")
    strings = cut(strings, "strings")
    often = strings.groupBy("h", "at", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    counted = strings.join(often, ["h", "at", "string"]).groupBy("h", "w").agg(
        F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + LENGTH).alias("e"))).alias("ranges")
    )
    # Classes of two or more are repeated throughout.
    whole = classes.where((F.col("n") > 1) & (F.col("one.hi") - F.col("one.lo") >= LENGTH)).select(
        "h", "w", F.array(F.struct(F.col("one.lo").alias("s"), F.col("one.hi").alias("e"))).alias("ranges")
    )
    ranges = cut(built.unionByName(counted).unionByName(whole), "class-ranges")
    covered = (
        places.select("r1", "r2", "h", "w", "pos").join(ranges, ["h", "w"])
        .select("r1", "r2", F.transform("ranges", lambda r: F.struct((F.col("pos") + r["s"]).alias("s"), (F.col("pos") + r["e"]).alias("e"))).alias("ranges"))
        .unionByName(found.where("stop IS NOT NULL").select("r1", "r2", F.array(F.struct(F.col("pos").alias("s"), F.col("stop").alias("e"))).alias("ranges")))
    )
    by_row = cut(covered.groupBy("r1", "r2").agg(F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges")), "row-ranges")
    rows = docs.select(F.col("doc_id").cast("long"), key(False).alias("r1"), key(True).alias("r2"), data.alias("data"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return rows.join(by_row, ["r1", "r2"], "left").select("doc_id", "data", "ranges").mapInArrow(_cut_texts(with_kept), schema)
