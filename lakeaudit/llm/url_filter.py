"""URL filters: host and path rules, propagated over redirect and canonical links (built-in functions only).

A rule is an action, a host and a path prefix. It fits its host and every subdomain
when the url's path starts with the rule's path; the longest fitting rule decides
(at equal length allow goes before block, then the smaller rule string).

Pages that state a canonical link (``<link rel="canonical" href>``) or a redirect
(``<meta http-equiv="refresh" content="0; url=...">``) name another address of the same
content. Connected components over these edges are alias classes, found by alternating
large-star and small-star rounds on an edge table that is rewritten to the shared folder
each round; a hub that a third of all pages point at is a key of a grouped minimum
(combined before the shuffle) and of a join that adaptive execution splits.

Verdict of a url: its own rule's action. Without a fitting rule: allow when any alias
is explicitly allowed, else block when any alias is blocked, else allow.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and
the verdict allow; null html has no edges; empty tables give no rows; repeated rows are
judged one by one; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The contract's rules (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """An address without scheme and fragment, its host lower-cased; null without ``://``."""
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The fitting rule as struct(size, allow, rule, action), null if none fits."""
    fitting = [
        F.when(
            ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path),
            F.struct(
                F.lit(-len(rule_host + rule_path)).alias("size"),
                F.lit(0 if action == "allow" else 1).alias("later"),
                F.lit(rule_host + rule_path).alias("rule"),
                F.lit(action).alias("action"),
            ),
        )
        for action, rule_host, rule_path in rules
    ]
    return F.array_min(F.array(*fitting)) if fitting else F.lit(None).cast("struct<size:int,later:int,rule:string,action:string>")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses that pages declare to be one, each pair once, a < b, no loops."""
    html = F.col("html")
    told = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    tags = F.regexp_extract_all(
        F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b.*?</\1\s*>", ""),
        F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"),
        F.lit(1),
    )
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    goes = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*['"]?\s*([^"'\s>]+)""", 1)
    target = (
        F.when(F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), href)
        .when(F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""), goes)
    )
    url, to = F.col("url"), F.regexp_replace("target", "&amp;", "&")
    scheme, place = F.regexp_extract(url, r"^(.*?)://", 1), F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    resolved = (
        F.when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(F.instr(to, "://") > 0, to)
        .when(to.startswith("/"), F.concat(place, to))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), to))
    )
    ends = (
        pages.select("url", "html")
        .where(told & (F.instr("url", "://") > 0))
        .select("url", F.explode(tags).alias("tag"))
        .select("url", target.alias("target"))
        .where(F.col("target") != "")
    )
    goals = cut(ends, "declared-links").select("url", resolved.alias("goal"))
    # Written before the conditions, which would else repeat the whole expressions beyond what is compiled.
    ends = cut(goals.select(node_of(url).alias("u"), node_of(F.col("goal")).alias("v")), "declared-ends").where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    )
    return ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node of its component.

    Alternates large-star and small-star until a round changes nothing; the number of
    rounds grows with the logarithm of the node count.
    """
    edges = cut(edges.select("a", "b"), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
        """Link the (larger / no larger) neighbours of every node to its least neighbour."""
        least = pairs.groupBy("n").agg(F.min("m").alias("least"))
        # Written, so that the join below meets two plain inputs, which adaptive execution splits
        # at a hub; joined to an aggregate on its own key, a hub's neighbours stay in one task.
        least = cut(least.select(F.col("n").alias("k"), F.least("n", "least").alias("root")), "least")
        if larger_only:
            out = pairs.where(F.col("m") > F.col("n")).join(least, F.col("n") == F.col("k")).select(F.col("m").alias("x"), "root")
        else:
            kept = pairs.join(least, F.col("n") == F.col("k")).select(F.col("m").alias("x"), "root")
            out = kept.unionByName(least.select(F.col("k").alias("x"), "root"))
        return out.where(F.col("x") != F.col("root")).select(F.col("root").alias("a"), F.col("x").alias("b")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while True:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        large = cut(star(both, larger_only=True), "large-star")
        down = large.select(F.col("b").alias("n"), F.col("a").alias("m"))
        edges = cut(star(down, larger_only=False), "small-star")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_root for every row of ``pages`` (page_id, url, html)."""
    host, path = F.col("host"), F.col("path")
    nodes = connected_components(alias_edges(pages))
    address = F.concat(F.lit("x://"), F.col("node"))
    judged = nodes.withColumn("fit", rule_of(host_of(address), path_of(address), rules)["action"])
    classes = judged.groupBy("root").agg(
        F.max(F.col("fit") == "allow").alias("allowed"), F.max(F.col("fit") == "block").alias("blocked")
    )
    said = cut(
        classes.where(F.coalesce("allowed", F.lit(False)) | F.coalesce("blocked", F.lit(False)))
        .select("root", F.when(F.coalesce("allowed", F.lit(False)), "allow").otherwise("block").alias("said")),
        "alias-verdicts",
    )
    aliases = cut(
        nodes.join(said, "root", "left").select(F.col("node").alias("at"), F.col("root").alias("alias_root"), "said"), "aliases"
    )
    own = pages.select("page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("at")
    )
    own = own.withColumn("fit", rule_of(host, path, rules))
    return own.join(aliases, "at", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.action", "said", F.lit("allow")).alias("verdict"),
        "alias_root",
    )
