"""Each operator against a brute-force version, and its defined cases on small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from lakeaudit.llm import ann, decontaminate, html_text, line_dedup, ngram_join, packing, quality, queries, repeats, url_filter, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} other{i}" for i in range(4000))


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(1, None), (2, ""), (3, LONG), (4, LONG), (5, "same line\nsame line"), (5, "same line\nsame line"), (None, "no id"), (None, None), (6, "\n\n"), (7, "\x00 ﻿ é́")]
    return spark.createDataFrame([(a, b, 1, "x", 2.0) for a, b in rows], "doc_id long, text string, n long, key string, score double")


def test_quality_keeps_clean_and_rejects_poor(spark):
    got = {r.doc_id: r.keep for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good, poor = [got[r.doc_id] for r in labels if r.quality], [got[r.doc_id] for r in labels if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.1


def test_quality_returns_the_weak_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.weak_labels(docs)
    texts = dict(documents(spark))
    for r in queries.op1_quality(spark, SF).collect():
        places = quality._tokens.look_up(texts[r.doc_id] or "")
        pattern = sum(v * 3**i for i, v in enumerate(quality.votes(places, quality._tokens.facts))) if len(places) else None
        assert r.posterior == pytest.approx(1.0 if pattern is None else model.posterior(np.array([pattern]))[0])
    got = {r.labeller: r.accuracy for r in quality.labeller_accuracies(docs).collect()}
    assert got == pytest.approx(model.accuracies()) and set(got) == set(quality.LABELLERS)
    assert all(0 <= a <= 1 for a in got.values())


def test_join_equals_brute_force(spark):
    sets = {d: shingles(t) or {tuple(words(t)) or t} for d, t in documents(spark)}
    links = {d: {o for o, y in sets.items() if o != d and len(x & y) >= 0.8 * len(x | y)} for d, x in sets.items()}

    def least(d):
        seen, todo = {d}, [d]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    expected = {(d, least(d), len(x)) for d, x in links.items()}
    assert {tuple(r) for r in queries.op2_ngram_join(spark, SF).collect()} == expected
    # the same with every group dealt in blocks
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {tuple(r) for r in ngram_join.join_near(docs, group_rows=2).collect()} == expected


def test_one_row_of_each_component_stays(spark):
    base = [f"w{i}" for i in range(200)]
    near, other, third = " ".join([*base[:199], "x"]), " ".join(f"v{i}" for i in range(50)), " ".join(f"u{i}" for i in range(50))
    rows = [
        (1, " ".join(base), "a"), (None, near, "a"), (None, "clean text without an id", "b"), (None, "another clean text", "c"),  # a copy and clean texts without id
        (5, near, "a"), (5, "unique text of a shared id", "d"), (5, other, "e"), (4, other + " end", "e"),  # a copy and clean texts of one id
        (6, third, "f"), (3, other + " stop", "e"), (6, third, "f"), (7, third, "f"), (6, "own text", "g"), (8, None, "h"), (8, "", "h"),
        (20, "A " + third + " tail", "f"),
    ]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()
    assert sorted((r.part, -1 if r.doc_id is None else r.doc_id) for r in kept) == [
        ("a", 1), ("b", -1), ("c", -1), ("d", 5), ("e", 3), ("f", 6), ("g", 6), ("h", 8)
    ]


def test_pruning_keeps_pairs_at_the_threshold():
    steps = [20, 40, 60]
    needed = ngram_join.least_agreeing(0.8, 1e-6, steps)
    assert all(m < 0.8 * n for m, n in zip(needed, steps)) and needed[-1] > 0


def test_pairs_of_a_group_need_no_common_band():
    assert (1 - 0.8**ngram_join.BAND) ** (ngram_join.HASHES // ngram_join.BAND) <= ngram_join.TOLERANCE
    # two sets at similarity 0.9 whose signatures differ in one value of every four: no band of theirs is equal
    sets = [np.arange(95, dtype=np.uint64), np.arange(5, 100, dtype=np.uint64)]
    signed = np.tile(np.arange(ngram_join.HASHES, dtype=np.uint32), (2, 1))
    signed[1, ::4] += 1000
    steps = list(range(20, ngram_join.HASHES + 1, 20))
    needed = ngram_join.least_agreeing(0.8, ngram_join.TOLERANCE, steps)
    (found,) = ngram_join._linked(sets, signed, None, 0.8, needed)
    assert found[0] == 0 and found[1].tolist() == [1]


def test_urls(spark):
    rows = [
        (1, "http://a.example.com/en/x?q", None), (2, "HTTP://WWW.Example.COM/en/", "<p>"), (3, "http://x.net/fr/1", '<link rel="canonical" href="http://y.org/1">'),
        (4, "http://y.org/1", ""), (5, "http://z.org/2", '<meta http-equiv="refresh" content="0; url=/3">'), (6, "http://z.org/3#top", '<link href="//y.org/1" rel=canonical>'),
        (7, None, None), (8, "no scheme", "x"), (9, "http://q.org/", '<!-- <link rel="canonical" href="http://x.net/fr/1"> -->'), (4, "http://y.org/1", ""),
        (10, "http://a.org/p", '<link rel="canonical" href="http://a.com/p">'), (11, "http://b.net/es/p", '<link rel="canonical" href="http://a.com/p">'),
    ]
    df = spark.createDataFrame([(*r, "junk") for r in rows], "page_id long, url string, html string, host string")
    got = collections.defaultdict(list)
    for r in url_filter.filter_urls(df).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.example.com", "/en/x", "example.com/en/", "block")]
    assert got[2] == [("www.example.com", "/en/", "www.example.com/en/", "allow")]
    assert got[3] == [("x.net", "/fr/1", "net/fr/", "block")]
    assert got[4] == [("y.org", "/1", None, "block")] * 2
    assert got[5][0][3] == got[6][0][3] == "block"  # through two redirects
    assert got[7] == got[8] == [("", "", None, "allow")] and got[9][0][3] == "allow"
    assert got[10][0][3] == "allow" and got[11][0][3] == "block"  # an allowed alias goes first; an own rule always holds
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")]
    got = {r.node: r.root for r in url_filter.connected_components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["y"] == got["x"] == "x"


def test_html():
    page = (
        '<html><head><title>t</title></head><body><nav><a href="/">menu</a></nav><div class="ad">buy buy buy buy buy</div><div id="cookie-notice">we use</div>'
        "<article><h1>The &amp; head</h1><p><b>First  one.<br>Next<p>Second\n &eacute;&#x41;<ul><li>a<li>b</ul><form>f</form><script>var t='</p>';</script></article>"
        '<section class="comments"><p>I disagree with all of this</p></section><aside>side</aside><footer>&copy; me</footer></body></html>'
    )
    assert html_text.main_text(page) == "The & head\n\nFirst one. Next\n\nSecond éA\n\na\n\nb"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain < text") == "plain < text"
    for broken in ("<p", "</div></p>x", "<a b=\"c>d", "<!-- x", "<div><span></div>y</span>", "<" * 2000):
        html_text.main_text(broken)


def test_html_reads_on_after_embedded_elements():
    for tag in ('<svg width="9"/>', "<math/>", "<svg><style/><path d='M0'/></svg>", "<select><option>gone", "<object data=x>", "<noscript>", "<iframe src=x>", "<template>", "<noscript><p>gone</p></noscript>", "<select><option>gone<option>gone</select>"):
        page = f"<body><article><h1>Head</h1><p>First {tag}<p>Second part</p><div>Third</div></article><footer><svg></svg><iframe></iframe><object></object> end</footer></body>"
        assert html_text.main_text(page) == "Head\n\nFirst\n\nSecond part\n\nThird", tag
    assert html_text.main_text("<svg>" * 3000 + "text") == "text"


def test_html_keeps_the_whole_article():
    text = " ".join(["word"] * 60)
    three = f"<div><p>{text}</p><p>{text}</p><p>{text}</p></div>"
    blocks = "\n\n".join([text] * 3)
    links = "<ul>" + "<li><a href=x>another page</a>" * 5 + "</ul>"
    body = f"<h1>Short title</h1>bare<p>Intro</p>{three}<section><p>Sparse</p></section>"
    expected = f"Short title\n\nbare\n\nIntro\n\n{blocks}\n\nSparse"
    for page in (f"<article>{body}</article>", f"<body><div class='page has-sidebar'><article>{body}</article></div>", f"<body>{links}<main>{links}{body}</main>", f"<body>{links}<div class=has-sidebar><div>{body}</div>{links}</div>"):
        assert html_text.main_text(page) == expected, page
    assert html_text.main_text(f"<body><h1>Title</h1><main><article>{three}</article></main><div class='site-header'>{text}</div>") == f"Title\n\n{blocks}"


def test_html_of_every_page(spark):
    got = {r.page_id: r for r in queries.op4_html_extract(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        import html as h

        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|b)>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_decontamination_equals_brute_force(spark):
    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = {(d, i, len(x & s), len(x)) for d, t in documents(spark) for s in [shingles(t)] for i, x in items.items() if x and len(x & s) >= 0.8 * len(x)}
    got = {tuple(r)[:4] for r in queries.op5_decontaminate(spark, SF).collect()}
    assert got == expected and expected
    odd, bench = odd_documents(spark), spark.createDataFrame([(1, None), (2, "too short"), (None, "word5 other5 word6 other6 word7 other7")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(odd, bench).collect()} == {(3, None), (4, None)}
    assert decontaminate.drop_contaminated(odd, bench).count() == 8
    assert decontaminate.find_contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_judges_each_row(spark):
    word = [f"w{i}" for i in range(120)]
    item, halves = " ".join(word[:100]), (" ".join(word[:50]), " ".join(word[46:100]))
    rows = [(None, item, "bad"), (None, "clean text without an id at all", "clean"), (None, halves[0], "clean"), (None, halves[1], "clean")]
    rows += [(5, item + " more", "bad"), (5, "clean text of a shared id", "clean"), (6, halves[0], "clean"), (6, halves[1], "clean"), (7, None, "clean"), (8, item, "bad"), (8, item, "bad")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, part string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(r) for r in rows if r[2] == "clean")
    # the search reports an id only if one of its rows holds the item; halves in two rows of an id do not
    assert {r.doc_id: r.n_shared for r in decontaminate.find_contaminated(docs, bench).collect()} == {None: 96, 5: 96, 8: 96}


def test_warc_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u\r\n%0A", "same"), (3, None, None), (4, "v", ""), (5, "w", LONG), (None, "x", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = {r.page_id: r for r in warc.warc_round_trip(df).collect()}
    payloads = {i: (h or "").encode() for i, _, h in rows}
    for i, r in got.items():
        assert r.payload_bytes == len(payloads[i]) and r.payload_digest == base64.b32encode(hashlib.sha1(payloads[i]).digest()).decode()
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 5, None)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None), ("revisit", 2)]
    assert got[2].url == "u\r\n%0A" and got[3].url is None
    assert {r.record_type for r in warc.warc_round_trip(df, min_revisit_bytes=10**6).collect()} == {"response"}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_faults():
    good = warc.record_bytes(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "response", None)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), b""):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_lines_equal_brute_force(spark):
    fold = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)

    def brute(docs, least):
        key = lambda line: line.strip(line_dedup.BLANKS).translate(fold)
        seen = collections.defaultdict(set)
        for row, (_, t) in enumerate(docs):
            for line in (t or "").split("\n"):
                seen[key(line)].add(row)
        kept = lambda line: not key(line) or len(seen[key(line)]) < least
        return sorted(
            (-1 if d is None else d, len(lines), len(lines) - sum(map(kept, lines)), "\n".join(filter(kept, lines))) for d, t in docs for lines in [(t or "").split("\n")]
        )

    for frame, least in ((spark.read.parquet(f"{SF}/documents.parquet"), 10), (spark.read.parquet(f"{SF}/documents.parquet"), 2), (odd_documents(spark), 2)):
        docs = [(r.doc_id, r.text) for r in frame.collect()]
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_frequent_lines(frame, least).collect())
        assert got == brute(docs, least)
    assert line_dedup.drop_frequent_lines(odd_documents(spark).limit(0)).count() == 0
    # twelve equal rows are twelve documents, and so are rows without an id
    for ids in ([1] * 12, [None] * 12, [*range(9), None]):
        equal = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
        assert {(r.n_dropped, r.text) for r in line_dedup.drop_frequent_lines(equal).collect()} == {(1, "")}


def test_packing_equals_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    extra = spark.createDataFrame([(-1, None), (-2, "a\tb\r\nC'est don't 3x!! <|endoftext|> é́ İ ΑΣ x\x1cy"), (-3, "x " * 9000)], "doc_id long, text string")
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(extra)
    expected = {}
    for r in frame.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            expected[r.doc_id, piece] = at, len(own), zlib.crc32(own.tobytes())
    rows = packing.pack(packing.tokenize(frame, queries.tokenizer_path()), group_rows=50).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.05 * -(-sum(v[1] for v in expected.values()) // 4096) + 1


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = collections.defaultdict(list)
    for r in sorted(queries.op9_nearest(spark, "/root/testdata/sf0.01").collect()):
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got[q]))
    assert hits / (20 * len(got)) >= 0.9 and all(len(v) == 20 for v in got.values())


def test_nearest_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 2, 0.0), (20, 3, 3, 0.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_rows_that_share_an_id(spark):
    """Two rows of id 20 with different vectors, and equal rows of id 40, ask each for themselves and find the others."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5]), (21, [0.9, 0.1]), (22, [0.1, 0.9]), (23, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.Counter(tuple(r) for r in ann.nearest(df, k=3).collect())
    expected = collections.Counter()
    for at, (own, v) in enumerate(rows):
        if own % 20 == 0:
            others = sorted((-float(np.dot(v, w)), i, float(np.dot(v, w))) for place, (i, w) in enumerate(rows) if place != at)
            expected.update((own, rank, i, s) for rank, (_, i, s) in enumerate(others[:3], 1))
    assert found == expected


def brute_repeats(docs, length=400):
    seen = collections.Counter()
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(b)] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((-1 if d is None else d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group_windows", [20_000, 1])
def test_repeats_equal_brute_force(spark, group_windows):
    passage = " ".join(f"p{i}q" for i in range(120))  # over 400 bytes
    planted = [(-10 - i, f"begin {i} {i * i}\n" + passage[: 400 + 3 * i] + f" end {i}") for i in range(12)]
    planted += [(-30, "ab" * 900), (-31, "x" + "ab" * 260), (-32, "é" * 300 + "z" + "é" * 300), (-33, passage[50:449]), (-34, "\x00" * 450), (None, LONG), (-35, LONG), (-36, None), (-37, "")]
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    got = repeats.remove_repeats(frame, group_windows=group_windows).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_repeats(docs)


def test_empty_and_odd_tables(spark):
    odd = odd_documents(spark)
    assert quality.classify(odd).count() == 10 and quality.keep_good(odd).columns == odd.columns
    assert ngram_join.join_near(odd).count() == 10 and ngram_join.keep_one(odd).columns == odd.columns
    assert repeats.remove_repeats(odd).count() == 10
    none = odd.limit(0)
    for made in (quality.classify(none), ngram_join.join_near(none), repeats.remove_repeats(none), packing.pack(packing.tokenize(none, queries.tokenizer_path()))):
        assert made.count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == start.columns and after.count() <= docs.count(), name
        docs = after
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert not {r.doc_id for r in decontaminate.find_contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
