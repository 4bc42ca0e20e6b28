"""URL filters with redirect equivalence.

Pages whose redirects or canonical links connect them are aliases: a block that an explicit
rule gives to one of them holds for every alias without a rule of its own.  An url's own rule,
allow or block, always comes first; allow is the verdict where nothing blocks.  Components are
found by alternating large-star and small-star rounds on the edge table, each round written to
the shared folder, so no node's edges and no component is ever gathered in one task.

Defined results: null urls and urls without ``://`` have an empty host and path and no rule;
urls that differ in the case of scheme or host or in the fragment are one node;
pages without edges are their own component; repeated rows are judged each; empty tables give
no rows; rules of equal length can't both be longest for one url unless they are the same rule,
in which case block loses to allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import drop_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null.  The rule list is part of the plan, so it is small by nature."""
    out = None
    for r in sorted(set(rules), key=lambda r: (-len(r.text), r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if out is None else out


def url_node(url: Column) -> Column:
    """The url as a node: scheme and host lower-cased, no fragment.  Without ``://`` the text itself."""
    head = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), UPPER, LOWER)
    return F.when(url.contains("://"), F.concat(head, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))).otherwise(url)


def alias_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes from canonical links and from refreshing meta tags.

    Relative targets are resolved against the page: its scheme, host, path, or the folder of its
    path; dot segments stay as written.  Pages whose url has no ``://`` have full targets only.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    tag = lambda pattern: F.regexp_extract(body, pattern, 0)
    link = F.regexp_extract(tag(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    link_before = F.regexp_extract(tag(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), r"(?is)\bhref\s*=\s*\"([^\"]*)\"", 1)
    meta = F.regexp_extract(tag(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    origin = F.regexp_extract(F.col(url), r"(?s)^(.*?://[^/?#]*)", 1)
    targets = F.array(F.when(link_before != "", link_before).otherwise(link), meta)
    # the cheap test first: most pages have neither tag
    rows = pages.filter(F.col(url).isNotNull() & (F.lower(body).contains("canonical") | F.lower(body).contains("refresh")))
    rows = rows.select(F.col(url).alias("src"), origin.alias("origin"), url_path(F.col(url)).alias("path"), F.explode(targets).alias("t")).filter("t <> '' and t not like '#%'")
    folder = F.when(F.col("path") == "", F.lit("/")).otherwise(F.regexp_extract("path", r"(?s)^(.*/)", 1))
    full = F.when(F.col("t").contains("://"), F.col("t")).when(F.col("t").startswith("//"), F.concat(F.regexp_extract("origin", "^([^:]*:)", 1), F.col("t"))).when(F.col("origin") == "", F.lit(None)).when(F.col("t").startswith("/"), F.concat("origin", "t")).when(F.col("t").startswith("?"), F.concat("origin", "path", "t")).otherwise(F.concat("origin", folder, "t"))
    return rows.select(url_node(F.col("src")).alias("src"), url_node(full).alias("dst")).filter("src <> dst")


def components(edges: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that edges connect it with.

    Alternating stars (Kiveris et al.): each round points a node's larger neighbours, then its
    smaller ones, at the smallest; pre-aggregated minima and skew-splitting joins keep hubs spread.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    held, path = written(pairs, "edges")
    mark = None
    for _ in range(max_rounds):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        fresh, fresh_path = written(small, "edges")
        now = tuple(fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_path(spark, path)
        held, path = fresh, fresh_path
        if now == mark:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def judged(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", html: str | None = "html", edges: DataFrame | None = None) -> DataFrame:
    """key, host, path, rule, verdict, component (the smallest alias url; null without aliases).

    ``edges`` (src, dst urls) takes the place of the links found in ``html``, as from a crawl's redirects.
    """
    edges = edges.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst")).filter("src <> dst") if edges is not None else None
    edges = alias_edges(pages, url=url, html=html) if edges is None and html else edges
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    base = base.select("key", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    base = base.withColumn("aka", url_node(F.col("url"))).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    own_rule, own_verdict = F.col("own.rule").alias("rule"), F.col("own.verdict")
    held, held_path = written(edges, "alias-edges") if edges is not None else (None, None)
    if held is None or held.isEmpty():
        return base.select(F.col("key").alias(key), "host", "path", own_rule, F.coalesce(own_verdict, F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    groups = components(held)
    # nodes are judged by themselves: a redirect's target need not be a page
    node = groups.withColumn("r", rule_of(url_host(F.col("node")), url_path(F.col("node")), rules))
    blocked = node.groupBy("component").agg(F.max(F.col("r.verdict") == "block").alias("blocked"))
    alias = groups.join(blocked, "component")
    joined = base.join(alias, base.aka == alias.node, "left")
    return joined.select(F.col("key").alias(key), "host", "path", own_rule, F.coalesce(own_verdict, F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"), "component")
