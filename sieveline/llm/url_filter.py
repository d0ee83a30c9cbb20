"""URL rules, and block decisions carried to aliases, in built-in expressions only.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains, and the longest that fits wins.
Redirects (meta refresh) and canonical links make two addresses aliases. Distributed connected components group aliases;
a page without a rule takes its group's verdict: allow if any address of the group has an allow rule, else block if any
has a block rule, else allow. Links are read as a browser does: on the page's base, with character references, and with
a scheme's own port and an empty path left out of the address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import quoted
from sieveline.operators.components import connected_components
from sieveline.plans.durable import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta|base)\b[^>]*>"
BASE = r"(?i)<base\b[^>]*\bhref\s*=[^>]*>"
#: Character references that urls hold, the plain ampersand last.
REFERENCES = (("&(?i:quot|#34|#x22);", '"'), ("&(?:apos|#39|#x27);", "'"), ("&(?i:lt|#60|#x3c);", "<"), ("&(?i:gt|#62|#x3e);", ">"), ("&(?:#47|#x2[fF]|sol);", "/"), ("&(?i:amp|#38|#x26);", "&"))
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
SCHEME, QUERY = "^[A-Za-z][A-Za-z0-9+.-]*:", r"^[^?#]*(\?[^#]*)"
REFRESH = r"""(?i)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, where an expression would be copied to each of its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _address(url: Column) -> Column:
    """What aliases are compared by: host, path (empty for /) and query, without scheme, its own port, and fragment; null without a host."""
    query = F.regexp_extract(_rest(url), QUERY, 1)
    port = F.when(url.rlike("(?i)^https:"), ":443$").when(url.rlike("(?i)^http:"), ":80$").otherwise(":(?:80|443)$")
    host = F.regexp_replace(host_of(url), port, F.lit(""))
    path = F.when(path_of(url) == "/", "").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host, path, query))


def _plain(target: Column) -> Column:
    """An attribute's text with its character references resolved."""
    for pattern, character in REFERENCES:
        target = F.regexp_replace(target, pattern, character)
    return target


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its segments . and .., as RFC 3986 removes them."""
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    step = lambda done, s: F.when(s == ".", done).when(s == "..", up(done)).otherwise(F.array_append(done, s))
    left = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(left, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def _resolved(url: Column, target: Column) -> Column:
    """A target without scheme and host as a url on the page's host, its path taken from the page's where it isn't whole."""
    path, query, base = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, QUERY, 1), path_of(url)
    folder = F.when(base == "", "/").otherwise(F.regexp_extract(base, "(?s)^.*/", 0))
    moved = F.concat(_without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), query)
    same = F.concat(base, F.when(query != "", query).otherwise(F.regexp_extract(_rest(url), QUERY, 1)))
    return F.concat(F.lit("http://"), host_of(url), F.when(path == "", same).otherwise(moved))


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null. The list is a parameter, bounded by the caller."""
    found = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.greatest(*found, F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))


def _absolute(url: Column, target: Column) -> Column:
    """A target as a browser resolves it on a url; null for other schemes than those with a host."""
    scheme = F.regexp_extract(url, SCHEME, 0)
    return (
        F.when(target.rlike(SCHEME + "//"), target)
        .when(target.startswith("//"), F.concat(F.when(scheme == "", "http:").otherwise(scheme), target))
        .when(~target.rlike(SCHEME), _resolved(url, target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) addresses joined by a canonical link or a meta refresh.

    Relative targets are resolved on the page's first <base href>, or on the page; a null html or url has no edge.
    """
    pages = pages.select(quoted(url_col).alias("url"), quoted(html_col).alias("html"))
    html, url = F.col("html"), F.col("url")
    href = F.trim(_plain(F.regexp_extract(F.regexp_extract(html, BASE, 0), HREF, 1)))
    at = _let(href, lambda h: F.when(h != "", F.coalesce(_absolute(url, h), url)).otherwise(url))
    tags = pages.where(html.rlike(TAG)).select(
        "url", F.explode(_let(at, lambda a: F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: F.struct(a.alias("at"), t.alias("tag"))))).alias("x")
    )
    tag, at = F.col("x.tag"), F.col("x.at")
    target = F.when(tag.rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?canonical\b"""), F.regexp_extract(tag, HREF, 1)).when(
        tag.rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(tag, REFRESH, 1)
    )
    dst = _let(_plain(target), lambda t: F.when(t != "", _let(_absolute(at, t), _address)))
    # src and dst in one value, so that the condition on them doesn't compute them again
    edges = tags.select(F.explode(F.array(F.struct(_let(F.col("url"), _address).alias("src"), dst.alias("dst")))).alias("e"))
    return edges.select("e.*").where("src <> dst").distinct()


def filter_urls(
    pages: DataFrame, rules: list[UrlRule], edges: DataFrame | None = None, url_col: str = "url", html_col: str = "html", id_col: str = "page_id"
) -> DataFrame:
    """id_col, host, path, rule, verdict for each row of ``pages``.

    ``edges`` (src, dst: urls, with or without a scheme) adds known redirects to those found in the pages. A null or
    malformed url has an empty host and path, no rule and no alias, and is allowed; null html has no edges; repeated rows
    get equal results; a page's own rule always stands above its group's verdict.
    """
    found = alias_edges(pages, url_col, html_col)
    edges = durable(found if edges is None else found.unionByName(edges.select(*[_address(F.when(F.col(c).contains("://"), F.col(c)).otherwise(F.concat(F.lit("x://"), F.col(c)))).alias(c) for c in ("src", "dst")])))
    groups = durable(connected_components(edges))
    at = F.concat(F.lit("x://"), F.regexp_replace("node", r"^([^/?]*)(\?|$)", "$1/$2"))  # an empty path is judged as /
    ruled = groups.select("component", rule_for(host_of(at), path_of(at), rules)["verdict"].alias("v")).where("v is not null")
    verdicts = durable(ruled.groupBy("component").agg(F.min("v").alias("v")))  # allow sorts before block
    by_address = durable(groups.join(verdicts, "component").select("node", "v"))
    url = quoted(url_col)
    judged = pages.select(quoted(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), _address(url).alias("address"))
    judged = judged.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    return judged.join(by_address, F.col("address") == F.col("node"), "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "v", F.lit("allow")).alias("verdict")
    )
