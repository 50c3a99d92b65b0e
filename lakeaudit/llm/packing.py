"""Best-fit packing by hierarchical residual rounds.

Documents are tokenized inside the tasks that read them and cut into pieces of at most
``capacity`` tokens. Packing then moves (piece, place) rows only, never tokens. Every
round deals the open bins to groups of about ``GROUP_ROWS`` rows; a group packs its bins
as items, largest first, each into the open bin with the least room that still fits.
Bins with at most ``SLACK`` tokens of room leave; the others are the next round's items
in fewer groups, until one group is left or a round no longer shrinks what is left.
Every piece has a number of its own, fixed when the pieces are written, and the groups are dealt by a hash of the
number, so no length, source, id or copy can fill one.

Tokenizing: white space never takes part in a token of this tokenizer, so a text is the
join of its words' ids. Each worker keeps the ids of words it has met lately (two generations of
``CACHE_WORDS`` at most) and drops them when another operator's task starts in it; new words go to the library
in blocks. Marks at a word's end are a word of their own where they follow a Latin letter that stays a
letter when it is normalised. Words of such letters only go to the library's model at once; every other
word takes the library's whole way.

Defined cases: null text is the empty text, whose only token is the end token; repeated
rows are separate documents; null doc_ids stay null; empty tables give no rows; other
input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, drop_caches, importable, keep_cache

CAPACITY, END_ID = 4096, 1
GROUP_ROWS, SLACK = 20_000, 16
CACHE_WORDS = 600_000
WORDS_PER_CALL = 500
SLICE_BYTES = 16_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, bin long, offset long, done boolean"


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's for the whole text."""

    BREAKS = str.maketrans("\n\t\r", "   ")
    #: Latin letters, without I with a dot (whose lower case has a mark). Such a letter and marks after it are never of one token.
    LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
    PLAIN = re.compile(f"[{LETTER}]+")
    MARKED = f"([{LETTER}])([,.!?*#&%$;:|]+)( |$)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # The same model without normalising and cutting, for words that need neither.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        # How the tokenizer spells the bytes of a letter beyond ASCII before it looks for tokens.
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        beyond = [c for c in map(chr, range(0x80, 0x250)) if self.PLAIN.fullmatch(c)]
        self.spelled = {ord(c): spell(c)[0][0] for c in {*beyond, *map(str.lower, beyond)}}
        self.chunks: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Lower-case words of Latin letters; each ends with its only token that ends a word, so one call serves many."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_PER_CALL):
            block = words[at : at + WORDS_PER_CALL]
            spelled = " ".join([w if w.isascii() else normalize("NFC", w).translate(self.spelled) for w in block])
            ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(block) or stops[-1] != len(ids):
                out += self._encode(block)
                continue
            raw, begin = ids.tobytes(), 0
            for stop in (stops * 4).tolist():
                out.append(raw[begin:stop])
                begin = stop
        return out

    def _learn(self, fresh: set[str]) -> None:
        """The ids of words that no generation holds."""
        chunks, plain = self.chunks, self.PLAIN.fullmatch
        letters = [w for w in fresh if plain(w)]
        odd = list(fresh.difference(letters))
        chunks.update(zip(odd, self._encode(odd)))
        lower = list({w.lower() for w in letters}.difference(chunks))
        chunks.update(zip(lower, self._encode_letters(lower)))
        chunks.update([(w, chunks[w.lower()]) for w in letters])

    def encode(self, texts: list[str]) -> list[bytes]:
        lines = [text.translate(self.BREAKS) if "\t" in text or "\r" in text else text.replace("\n", " ") for text in texts]
        cut_ = pc.replace_substring_regex(pa.array(lines, pa.string()), self.MARKED, r"\1 \2\3")
        split = pc.split_pattern(cut_, " ")
        flat = split.flatten().dictionary_encode()
        words, places = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy()
        fresh = set(words).difference(self.chunks)
        if len(self.chunks) + len(fresh) > CACHE_WORDS:  # a new generation; words still in use come over
            self.older, self.chunks = self.chunks, {"": b""}
            fresh = set(words).difference(self.chunks)
        kept = fresh & self.older.keys()
        older = self.older
        self.chunks.update([(w, older[w]) for w in kept])
        fresh -= kept
        if fresh:
            self._learn(fresh)
        # Each word's ids once, and then a gather over all words in their order.
        parts = list(map(self.chunks.__getitem__, words))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins, sizes = (np.cumsum(sizes) - sizes)[places], sizes[places]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.frombuffer(b"".join(parts), "<u4")[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], sizes)]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


keep_cache("packing", _tokenizer.cache_clear)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text); with ``with_ids`` also their ids (little-endian 32-bit)."""
    importable(docs.sparkSession)
    schema = PIECES + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches("packing")
        encoder = _tokenizer(tokenizer)
        for batch in batches:
            ends = np.cumsum(np.append(0, pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
                part = batch.slice(at, upto - at)
                at = upto
                doc_ids, rows = part.column(0).to_pylist(), []
                for doc_id, ids in zip(doc_ids, encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[begin : begin + 4 * capacity]
                        rows.append((doc_id, piece, begin // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                take = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:take], types)], names[:take])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the given order: for each item its bin and its place there, and the room left by bin."""
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    open_rooms = 0  # bit r is set while a bin with r tokens of room is open
    bins, places = [], []
    for size in sizes:
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            own = stack.pop()
            if not stack:
                open_rooms &= ~(1 << room)
        else:
            own, room = len(rooms), capacity
            rooms.append(capacity)
        bins.append(own)
        places.append(capacity - room)
        rooms[own] = left = room - size
        if left:
            by_room.setdefault(left, []).append(own)
            open_rooms |= 1 << left
    return bins, places, rooms


def _packer(level: int, last: bool, capacity: int, slack: int):
    """One round's work on one group of open bins."""

    def pack_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        _, own = np.unique(table.column("bin").to_numpy(), return_inverse=True)
        size = np.bincount(own, length).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        bins, places, rooms = best_fit(size[order].tolist(), capacity)
        new, place = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        new[order], place[order] = bins, places
        ready = np.ones(len(rooms), bool) if last else np.array(rooms) <= slack
        number = (level + 1 << 56) + (int(key[0].as_py()) << 32) + new[own]
        return pa.table(
            [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            + [pa.array(number), pa.array(table.column("offset").to_numpy() + place[own]), pa.array(ready[new[own]])],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "done"],
        )

    return pack_group


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, slack: int = SLACK) -> DataFrame:
    """Give every row of ``pieces`` a sequence_id and its offset there."""
    importable(pieces.sparkSession)
    # Round 0: every piece is a bin of its own number, which the written copy fixes.
    numbered = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))
    todo = cut(numbered, "pieces")
    left = todo.count()
    done, level, before = [], 0, None
    while True:
        groups = max(1, -(-left // group_rows))
        last = groups == 1 or (before is not None and left > 0.9 * before)
        group = _packer(level, last, capacity, slack)
        out = todo.withColumn("number", F.pmod(F.xxhash64("bin"), F.lit(groups))).groupBy("number").applyInArrow(group, PLACED)
        out = cut(out, f"packed-{level}")
        done.append(out.where("done"))
        if last:
            break
        todo = out.where("NOT done").drop("done")
        before, left = left, todo.count()
        level += 1
        if left == 0:
            break
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
