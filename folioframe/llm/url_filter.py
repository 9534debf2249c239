"""URL rules that reach aliases: redirects and canonical links make classes of equal pages, in DataFrame operations only.

Rules name a host (it and its subdomains) and a path prefix.  A page's own longest rule decides; a page without one takes the
decision of its class, where an explicit allow goes before a block, and is allowed if its class has no rule either.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.components import connected_components
from folioframe.operators.lineage import cut_lineage

_REL = r"""\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))"""  # one of its values
_CANONICAL = rf"""(?is)<link\b(?=[^>]*{_REL})[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
RULES = "host string, path string, verdict string"


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without a ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host up to the next ? or #; empty without a ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Host, path and query: what two URLs of one page share whatever their schemes and fragments; null without a ://."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host(url), rest))


def _without_dots(path: Column) -> Column:
    """An absolute path without its segments . and .., each .. taking the one before it along."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.array_append(parts, F.lit(""))).otherwise(parts)  # a dot at the end names a folder
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.array_append(done, x)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve(base: Column, target: Column) -> Column:
    """``target``, a link as it stands in html, as an absolute URL seen from the page ``base``; null where it names no page."""
    link = F.regexp_replace(target, "(?i)&(?:amp|#38|#x26);", "&")
    ahead, tail = F.regexp_extract(link, r"(?s)\A([^?#]*)", 1), F.regexp_extract(link, r"(?s)\A[^?#]*(.*)\z", 1)
    root = F.concat(F.regexp_extract(base, r"(?s)\A(.*?)://", 1), F.lit("://"), host(base))
    folder = F.regexp_extract(F.concat(F.lit("/"), F.substring(path(base), 2, 1 << 30)), r"(?s)\A(.*/)", 1)
    here = F.regexp_extract(base, r"(?s)\A([^?#]*)", 1)
    found = (F.when(link.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://"), link).when(link.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), F.lit(None))
             .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)\A(.*?)://", 1), F.lit(":"), link))
             .when(ahead == "", F.when(link.startswith("?"), F.concat(here, tail)))
             .otherwise(F.concat(root, _without_dots(F.when(ahead.startswith("/"), ahead).otherwise(F.concat(folder, ahead))), tail)))
    return F.when(base.contains("://") | link.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://"), found)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): a page's address and that of its canonical link or its refresh target.

    Relative targets are resolved against the page's URL, or against its first base element.
    """
    html, url = F.col(html_col), F.col(url_col)
    target = F.explode(F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), 1), F.regexp_extract_all(html, F.lit(_REFRESH), 1)))
    near = html.rlike("(?i)canonical|refresh")
    stated = F.regexp_extract(html, _BASE, 1)
    base = F.when(stated != "", F.coalesce(resolve(url, stated), url)).otherwise(url)
    return (pages.filter(near).select(address(url).alias("u"), base.alias("base"), target.alias("target"))
            .select("u", address(resolve(F.col("base"), F.col("target"))).alias("v")).filter("u is not null and v is not null").distinct())


def judge(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``addresses`` (columns host and path, one row per pair) with ``rule`` (host and path of the longest that fits) and ``own``."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (addresses.withColumn("suffix", F.explode(suffixes)).alias("a").join(rules.alias("r"), F.col("a.suffix") == F.col("r.host"))
            .filter(F.col("a.path").startswith(F.col("r.path"))).select("a.host", "a.path", F.concat("r.host", "r.path").alias("rule"), "r.verdict"))
    rank = F.struct(F.char_length("rule"), "rule", F.col("verdict") == "allow")
    best = fits.groupBy("host", "path").agg(F.max_by("rule", rank).alias("rule"), F.max_by("verdict", rank).alias("own"))
    return addresses.join(best, ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``rules`` has host, path (a prefix) and verdict; equal rules that disagree allow.  ``edges`` (u, v: URLs that are the same
    page, such as a crawl's redirects) add to those read from the html.  A null URL or one without :// has empty host and path,
    no rule and no aliases.  Null html has no links.  Repeated rows stay; input columns of the results' names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "address")
    links = link_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.union(edges.select(address(F.col("u")).alias("u"), address(F.col("v")).alias("v")).dropna())
    classes = connected_components(links)
    slim = pages.select("*", address(F.col(url_col)).alias("address"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    known = rules.select("host", "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    judged = cut_lineage(judge(slim.select("host", "path").distinct(), known))
    # Link targets need not be among the pages: every address of a class is judged.
    members = classes.withColumn("url", F.concat(F.lit("://"), "node")).select("node", "component", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    decided = judge(members.select("host", "path").distinct(), known).filter("own is not null")
    votes = members.join(decided, ["host", "path"]).groupBy("component").agg(F.min("own").alias("inherited"))
    aliases = classes.join(votes, "component").select(F.col("node").alias("address"), "inherited")
    verdict = F.coalesce("own", "inherited", F.lit("allow"))
    return (slim.join(judged, ["host", "path"]).join(aliases, "address", "left")
            .select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", "rule", verdict.alias("verdict")))
