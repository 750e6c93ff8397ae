"""URL rules with redirect equivalence, in DataFrame and SQL functions only.

The longest rule that fits a url decides it. Other urls take the decision of their
equivalents: a page, what it redirects to (meta refresh) and its canonical form
(canonical link, og:url, and the url without tracking parameters, fragment, mobile or
www host) are joined by connected components, and a component with a blocked url is
blocked, unless a rule allows one of its urls: an explicit allow goes first.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule, has no equivalents and is allowed. Of rules equally long an allow wins. Null html
has no links. Repeated rows and null ids get a row each; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import stash, table
from sloscope.llm.components import connected_components

#: (action, host, path): hand-written, a handful; each is tried on every url.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that don't name another page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[a-z]+)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(action, rule) of the longest rule that fits, or null."""
    if not rules:
        return F.lit(None).cast("struct<action: string, rule: string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule")))
        for action, h, p in ordered
    ]
    return F.coalesce(*fits)


def canonical_key(url: Column) -> Column:
    """The url's canonical form: host without www. or m., path without a closing slash or index file, other parameters in order."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m|mobile|amp)\.(?=[^.]+\.)|:(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(?:/(?:index\.html?)?)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}(?:=|$)")))
    return F.when(F.contains(url, F.lit("://")) & (host != ""), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def link_targets(html: Column) -> Column:
    """Addresses in canonical links, og:url and meta refresh of a page, as written."""
    tags = F.expr(r"regexp_extract_all(_html, '(?i)<(?:link|meta)\\b[^>]*+>', 0)")

    def of(which: str, attribute: str) -> Column:
        chosen = F.filter(tags, lambda t: t.rlike(which))
        return F.transform(chosen, lambda t: F.replace(F.trim(F.regexp_extract(t, attribute, 1)), F.lit("&amp;"), F.lit("&")))

    value = r"\s*=\s*[\x22']?\s*([^\x22'>\s]+)"
    found = F.concat(
        of(r"(?i)\brel\s*=\s*[\x22']?canonical\b", rf"(?i)\bhref{value}"),
        of(r"(?i)\bproperty\s*=\s*[\x22']?og:url\b", rf"(?i)\bcontent{value}"),
        of(r"(?i)\bhttp-equiv\s*=\s*[\x22']?refresh\b", r"(?i)\burl\s*=\s*[\x22']?([^\x22'>\s]+)"),
    )
    any_link = F.coalesce(html, F.lit("")).rlike("(?i)canonical|og:url|refresh")
    return F.when(any_link, F.filter(found, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def absolute(target: Column, url: Column) -> Column:
    """``target`` as seen from ``url``."""
    scheme, rest = F.regexp_extract(url, r"^([^:/?#]*)://", 1), F.regexp_extract(url, r"://([^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(scheme, F.lit("://"), rest, target))
        .otherwise(F.concat(scheme, F.lit("://"), rest, F.when(folder == "", "/").otherwise(folder), target))
    )


def filter_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the decision's source: rule, alias or default."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("_url"), F.col("html").cast("string").alias("_html"))
    rows = rows.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), canonical_key(F.col("_url")).alias("key"), "_url", link_targets(F.col("_html")).alias("targets"))
    urls = F.transform("targets", lambda t: absolute(t, F.col("_url")))
    rows = stash(rows.select("page_id", "host", "path", "key", deciding_rule(F.col("host"), F.col("path"), rules).alias("by"), F.when(F.col("key").isNotNull(), urls).alias("urls")), "url-pages")

    links = rows.select("key", F.explode("urls").alias("url"))
    links = links.select("key", canonical_key(F.col("url")).alias("target"), deciding_rule(host_of(F.col("url")), path_of(F.col("url")), rules).alias("by")).filter("target IS NOT NULL")
    edges = links.filter("key <> target").select(F.col("key").alias("a"), F.col("target").alias("b"))
    roots = stash(connected_components(edges), "url-roots")

    ruled = rows.filter("key IS NOT NULL").select("key", "by").union(links.select(F.col("target").alias("key"), "by")).filter("by IS NOT NULL")
    marks = [F.max(F.col("action") == "block").alias("block"), F.max(F.col("action") == "allow").alias("allow")]
    ruled = ruled.select("key", F.col("by.action").alias("action")).groupBy("key").agg(*marks)
    rooted = ruled.join(roots, ruled["key"] == roots["node"], "left").select(F.coalesce("root", "key").alias("root"), "block", "allow")
    blocked = rooted.groupBy("root").agg(F.max("block").alias("block"), F.max("allow").alias("allow")).filter("block AND NOT allow").select("root")
    names = stash(blocked.join(roots, "root").select(F.col("node").alias("key")).union(blocked.select(F.col("root").alias("key"))).distinct(), "url-blocked")

    alias = rows.join(names.withColumn("alias", F.lit(True)), "key", "left")
    verdict = F.when(F.col("by").isNotNull(), F.col("by.action")).when(F.col("alias"), "block").otherwise("allow")
    source = F.when(F.col("by").isNotNull(), "rule").when(F.col("alias"), "alias").otherwise("default")
    return alias.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), source.alias("source"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op6_url_filters": op6_url_filters}
_RULES_SQL = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in RULES)


def _host_sql(url: str) -> str:
    return f"translate(regexp_extract({url}, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"


def _path_sql(url: str) -> str:
    return f"regexp_extract({url}, '://[^/?#]*([^?#]*)', 1)"


def _key_sql(url: str) -> str:
    host = rf"regexp_replace(regexp_replace({_host_sql(url)}, '^(www|m|mobile|amp)\.([^.]+\.)', '\2'), ':(80|443)$', '')"
    path = rf"regexp_replace({_path_sql(url)}, '/(index\.html?)?$', '')"
    kept = rf"list_sort(list_filter(string_split(regexp_extract({url}, '://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^{TRACKING}(=|$)')))"
    query = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    return f"CASE WHEN contains({url}, '://') AND {host} <> '' THEN {host} || {path} || {query} END"


def _links_sql(which: str, attribute: str) -> str:
    return f"""list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)\\b{which}')), lambda t: replace(regexp_extract(t, '(?i)\\b{attribute}', 1), '&amp;', '&'))"""


_VALUE_SQL = r"\s*=\s*[\x22\x27]?\s*([^\x22\x27>\s]+)"

ORACLES = {
    "op6_url_filters": rf"""
        WITH RECURSIVE
        r(action, rhost, rpath) AS (VALUES {_RULES_SQL}),
        p AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url,
          regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>') AS tags FROM pages),
        raw AS (SELECT id, url, unnest(list_concat(list_concat(
          {_links_sql("rel" + r"\s*=\s*[\x22\x27]?canonical\b", "href" + _VALUE_SQL)}, {_links_sql("property" + r"\s*=\s*[\x22\x27]?og:url\b", "content" + _VALUE_SQL)}),
          {_links_sql("http-equiv" + r"\s*=\s*[\x22\x27]?refresh\b", r"url\s*=\s*[\x22\x27]?([^\x22\x27>\s]+)")})) AS t FROM p),
        target AS (SELECT id, {_key_sql("url")} AS k, CASE WHEN contains(t, '://') THEN t
          WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*)://', 1) || ':' || t
          WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || t
          ELSE regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || coalesce(nullif(regexp_replace({_path_sql("url")}, '[^/]*$', ''), ''), '/') || t END AS u FROM raw WHERE t <> ''),
        urls AS (SELECT id, page_id, url AS u, {_key_sql("url")} AS k, true AS page FROM p
          UNION ALL SELECT NULL, NULL, u, {_key_sql("u")}, false FROM target WHERE k IS NOT NULL),
        judged AS (SELECT urls.*, {_host_sql("u")} AS host, {_path_sql("u")} AS path FROM urls),
        best AS (SELECT judged.*, (SELECT struct_pack(action := action, rule := rhost || rpath) FROM r
          WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC, action LIMIT 1) AS by_rule FROM judged),
        e AS (SELECT DISTINCT k AS a, {_key_sql("u")} AS b FROM target WHERE k IS NOT NULL),
        both_ AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
        reach(action, k) AS (SELECT DISTINCT by_rule.action, k FROM best WHERE by_rule IS NOT NULL AND k IS NOT NULL
          UNION SELECT reach.action, b FROM reach JOIN both_ ON reach.k = both_.a)
        SELECT page_id, host, path, by_rule.rule AS rule,
          CASE WHEN by_rule IS NOT NULL THEN by_rule.action WHEN k IN (SELECT k FROM reach WHERE action = 'block') AND k NOT IN (SELECT k FROM reach WHERE action = 'allow') THEN 'block' ELSE 'allow' END AS verdict,
          CASE WHEN by_rule IS NOT NULL THEN 'rule' WHEN k IN (SELECT k FROM reach WHERE action = 'block') AND k NOT IN (SELECT k FROM reach WHERE action = 'allow') THEN 'alias' ELSE 'default' END AS source
        FROM best WHERE page"""
}
