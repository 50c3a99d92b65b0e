"""The operators bound to the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.quality import classify

    return classify(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "posterior", "score", "keep")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.ngram_join import join_near

    return join_near(read_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.url_filter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.html_text import extract_text

    return extract_text(read_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.decontaminate import find_contaminated

    return find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.warc import warc_round_trip

    return warc_round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.line_dedup import drop_frequent_lines

    return drop_frequent_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.packing import pack, tokenize

    return pack(tokenize(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.collocations import mine_phrases

    return mine_phrases(read_table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.periodic import find_runs, strongest, with_repeats

    found = find_runs(with_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeaudit.llm.simhash import near_components

    return near_components(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_ngram_join": op2_ngram_join,
    "op3_url_filter": op3_url_filter,
    "op4_html_extract": op4_html_extract,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_pack": op8_pack,
    "op9_nearest": op9_nearest,
    "op10_repeats": op10_repeats,
    "op11_collocations": op11_collocations,
    "op12_periodic": op12_periodic,
    "op13_simhash": op13_simhash,
}

# Fixed values of the contracts, as in the operators' modules.
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Rules as in url_filter.RULES; alias classes are the components over declared links.
OP3_SQL = rf"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (
  SELECT row_number() OVER () AS r, page_id, url, html,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
a AS (
  SELECT r, page_id, url, html,
         translate(regexp_extract(rest, '^[^/?#]*'), {_FOLD}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         CASE WHEN contains(url, '://') THEN
           translate(regexp_extract(rest, '^[^/?#]*'), {_FOLD}) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS node
  FROM p),
tags AS (
  SELECT url, node, unnest(regexp_extract_all(
           regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                                         '(?is)<script\b.*?</script\s*>', '', 'g'),
                          '(?is)<style\b.*?</style\s*>', '', 'g'),
           '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM a WHERE node IS NOT NULL),
links AS (
  SELECT url, node, replace(CASE
           WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
             THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
           WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
             THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*[''"]?\s*([^"''\s>]+)', 1)
           ELSE '' END, '&amp;', '&') AS target
  FROM tags),
resolved AS (
  SELECT node, CASE
           WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || target
           WHEN contains(target, '://') THEN target
           WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || target
           ELSE rtrim(regexp_extract(url, '^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/') || '/' || target END AS goal
  FROM links WHERE target <> ''),
edges AS (
  SELECT node AS u, translate(regexp_extract(substr(goal, instr(goal, '://') + 3), '^[^/?#]*'), {_FOLD})
                    || regexp_extract(substr(goal, instr(goal, '://') + 3), '^[^/?#]*([^#]*)', 1) AS v
  FROM resolved),
near AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(u, v) AS (
  SELECT u, v FROM near
  UNION
  SELECT reach.u, near.v FROM reach JOIN near ON reach.v = near.u),
nodes AS (
  SELECT DISTINCT node, host, path FROM a WHERE node IS NOT NULL
  UNION
  SELECT v, regexp_extract(v, '^[^/?#]*'), regexp_extract(v, '^[^/?#]*([^?#]*)', 1) FROM near),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY host, path
           ORDER BY length(rule_host || rule_path) DESC, action, rule_host || rule_path) AS place
  FROM (SELECT DISTINCT host, path FROM (SELECT host, path FROM a UNION SELECT host, path FROM nodes)) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT host, path, rule, action FROM fits WHERE place = 1),
said AS (
  SELECT reach.u AS node, min(action) AS action
  FROM reach JOIN nodes ON nodes.node = reach.v JOIN best USING (host, path) GROUP BY reach.u)
SELECT a.page_id, a.host, a.path, best.rule, coalesce(best.action, said.action, 'allow') AS verdict
FROM a LEFT JOIN best ON best.host = a.host AND best.path = a.path LEFT JOIN said ON said.node = a.node
"""

# Words and five-word shingles as texts; the containment is exact.
OP5_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w <> '') AS w
  FROM documents
  UNION ALL
  SELECT 'i', item_id, 0,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w <> '')
  FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, r, s FROM (
    SELECT side, id, r, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM words WHERE len(w) >= 5)),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE side = 'i'),
found AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, i.n_item
  FROM shingles d JOIN items i USING (s) WHERE d.side = 'd'
  GROUP BY d.id, d.r, i.id, i.n_item HAVING count(*) >= 0.8 * i.n_item)
SELECT doc_id, item_id, max(n_shared) AS n_shared, n_item, CAST(max(n_shared) AS DOUBLE) / n_item AS containment
FROM found GROUP BY doc_id, item_id, n_item
"""

# Base32 of the hex digest: five hex digits are four letters.
OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest
  FROM pages)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST(('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT)
               >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM p
"""

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), {_FOLD}) AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.r, k.doc_id, k.line, k.pos, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

# Phrases as texts, counted at every length; drops looked up in every longer phrase.
OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g
  FROM (SELECT lang, w, unnest(range(1, 6)) AS m FROM ws WHERE len(w) > 0) WHERE len(w) >= m),
f AS (SELECT lang, m, g, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w)) AS n FROM ws GROUP BY lang),
longer AS (
  SELECT DISTINCT lang, g, c FROM (
    SELECT lang, c, m, k, unnest(list_transform(range(1, m - k + 2), lambda i: g[i:i + k - 1])) AS g
    FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m > 2))),
cand AS (
  SELECT f.* FROM f WHERE m >= 2 AND NOT EXISTS (
    SELECT 1 FROM longer x WHERE x.lang = f.lang AND x.g = f.g AND 100 * x.c >= 100 * f.c)),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT cuts.lang, cuts.g, cuts.c AS a, k, x.c AS l, y.c AS r, n,
         (CAST(1000 AS HUGEINT) * cuts.c * n) // (CAST(x.c AS HUGEINT) * y.c) AS score
  FROM cuts JOIN total USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:k] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:cuts.m]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM named QUALIFY rank <= 2000
"""

# Every lag's matching stretches, from all pairs of equal 16-grams of a document; crc32 bit by bit.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
c AS (
  SELECT *, len(w) AS n, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))),
    lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS h
  FROM d),
t AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < (h // 10) % n THEN i ELSE
      (h // 10) % n + (i - (h // 10) % n) % (1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM c),
grams AS (SELECT r, n, unnest(range(0, n - 15)) AS i, unnest(list_transform(range(1, n - 14), lambda i: array_to_string(w[i:i + 15], ' '))) AS gram FROM t WHERE n >= 24),
pairs AS (SELECT a.r, a.i, b.i - a.i AS lag FROM grams a JOIN grams b USING (r, gram) WHERE b.i > a.i AND b.i - a.i <= a.n // 3),
stretches AS (SELECT r, lag, i, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS island FROM pairs),
runs AS (
  SELECT r, start, length, min(lag) AS period FROM (
    SELECT r, lag, min(i) AS start, count(*) + 15 + lag AS length FROM stretches GROUP BY r, lag, island)
  WHERE length >= greatest(24, 3 * lag) GROUP BY r, start, length),
each AS (
  SELECT r, list({'s': start, 'l': length, 'p': period} ORDER BY start, period) AS found,
         first({'s': start, 'l': length, 'p': period} ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best
  FROM runs GROUP BY r)
SELECT doc_id, coalesce(len(found), 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(array_to_string(list_transform(found, lambda x: x.s || ',' || x.l || ',' || x.p || chr(10)), ''), '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN found IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_bool_or(list_transform(found,
         lambda f: i - 1 >= f.s + f.p AND i - 1 < f.s + f.l))) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN each USING (r)
"""

#: The others have no SQL form: trained models, tokenizers, approximate search, byte positions.
ORACLE: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op12_periodic": OP12_SQL,
}
