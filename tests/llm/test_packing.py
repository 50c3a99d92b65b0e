"""Token ids equal to the library's over every script, and packing whose groups no repeated row can fill."""

from __future__ import annotations

import os
import random
import unicodedata
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lakeaudit.llm import packing, queries

ASSIGNED = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
MARKS = [*",.!?*#&%$;:|", "'s", "'t", "İ", "ı", "Σ", "ς", "ŉ", "ǅ", "Ⱥ", "̇", "́", " ", "\n", "\t", "\xa0"]


def random_texts(rng, count):
    latin, ascii_ = [chr(c) for c in range(0xA0, 0x250)], [chr(c) for c in range(9, 127)]
    scripts = [ASSIGNED[i : i + 200] for i in range(0, len(ASSIGNED), 200)][:80] + [latin] * 10 + [ascii_] * 20
    out = []
    for _ in range(count):
        script, words = rng.choice(scripts), []
        for _ in range(rng.randrange(0, 10)):
            word = "".join(rng.choice(script if rng.random() < 0.8 else rng.choice([ASSIGNED, latin, ascii_])) for _ in range(rng.randrange(0, 7)))
            words.append(word + "".join(rng.choice(MARKS) for _ in range(rng.randrange(0, 3))))
        out.append(rng.choice([" ", "\n", ""]).join(words))
    return out


@pytest.mark.parametrize("cache", [packing.CACHE_WORDS, 3_000])
def test_ids_equal_the_library_over_all_scripts(monkeypatch, cache):
    """The small cache starts new generations all the time."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", cache)
    path = queries.tokenizer_path()
    library, own, rng = Tokenizer.from_file(path), packing.WordTokenizer(path), random.Random(cache)
    for _ in range(25):
        texts = random_texts(rng, 2_000)
        expected = library.encode_batch(texts, add_special_tokens=False)
        assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in expected]
    stated = ["BELEDİYESİ,", "İ.", "naİ$", "İ", "", " ", "ΑΣ, ΑΣ. ΑΣ"]
    assert own.encode(stated) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(stated, add_special_tokens=False)]


def test_repeated_rows_with_null_ids_are_dealt_out(spark, monkeypatch, tmp_path):
    """A third of all rows is one row with a null id: no group takes much more than its share, and all is placed once."""
    rows = [(None, "the same text again " * 30)] * 1_000 + [(i, f"word{i} " * (i % 200 + 1)) for i in range(2_000)] + [(None, None), (3, "")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, bin long, offset long")
    pack, folder = packing._packer, str(tmp_path)

    def counted(*args):
        own = pack(*args)

        def run(key, table):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(f"{args[0]} {table.num_rows}")
            return own(key, table)

        return run

    monkeypatch.setattr(packing, "_packer", counted)
    pieces = packing.tokenize(docs, queries.tokenizer_path())
    placed = packing.pack(pieces, group_rows=100).collect()
    assert len(placed) == pieces.count() >= len(rows)
    first = [int(n) for level, n in ((tmp_path / name).read_text().split() for name in os.listdir(folder)) if level == "0"]
    assert len(first) > 25 and max(first) < 200
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():  # gapless from 0, and no longer than a sequence
        parts.sort()
        assert [offset for offset, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= packing.CAPACITY
    least = -(-sum(r.length for r in placed) // packing.CAPACITY)
    assert len(by_sequence) <= 1.03 * least + 2  # groups of 100 are small


def test_pieces_of_odd_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    long = " ".join(f"w{i % 701} naİ$" for i in range(9_000))
    rows = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, long), (3, "x\ty\r\nz")]
    docs = spark.createDataFrame([(a, b, "other") for a, b in rows], "doc_id long, text string, start string")
    expected = []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            own = np.array(ids[at : at + packing.CAPACITY], "<u4").tobytes()
            expected.append((doc or 0, piece, at, len(own) // 4, zlib.crc32(own)))
    got = packing.tokenize(docs, queries.tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    assert packing.pack(packing.tokenize(docs.limit(0), queries.tokenizer_path())).collect() == []
