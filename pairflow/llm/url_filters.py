"""URL filters: host and path rules, spread over redirect and canonical-link aliases (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, unplaced

#: (verdict, rule): host, then path from the first slash on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Query parameters that only say how a visitor came.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)=|^(utm_[a-z]+|ref|fbclid|gclid)$"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path up to ``?``, ``#`` or the end; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls where none fits. Among rules of one length, allow wins."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def canonical_url(url: Column) -> Column:
    """A url's node: no scheme, user, default port, leading www., fragment, tracking parameters or closing slash of the path."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"/+$", ""), query))


def absolute(link: Column, base: Column) -> Column:
    """A link found in a page, seen from the page's url; null for links to other kinds of resource."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    return (
        F.when(link.rlike(r"^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (link == "") | link.startswith("#"), F.lit(None))
        .otherwise(F.concat(folder, link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(a, b)`` between url nodes: the canonical link and the refresh target that a page declares in its html."""
    page = F.coalesce(F.col(html), F.lit(""))
    # whole tags of any length first; possessive repeats give nothing back, so a tag is read once
    tags = lambda name, has: F.filter(F.regexp_extract_all(page, F.lit(rf"(?i)<{name}\b[^>]*+>"), 0), lambda t: t.rlike(rf"(?i)\b{has}\b"))
    to = lambda t, name: F.regexp_extract(t, rf"(?i)\b{name}\s*+=\s*+[\"']?([^\"'\s>]+)", 1)
    canonical = F.transform(tags("link", r"rel\s*+=\s*+[\"']?canonical"), lambda t: to(t, "href"))
    refresh = F.transform(tags("meta", r"http-equiv\s*+=\s*+[\"']?refresh"), lambda t: to(t, "url"))
    out = pages.select(F.col(url).alias("_url"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("_to"))
    return out.select(canonical_url(F.col("_url")).alias("a"), canonical_url(absolute(F.col("_to"), F.col("_url"))).alias("b"))


def judge_urls(
    pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html"
) -> DataFrame:
    """All columns of ``pages`` plus ``host, path, rule, verdict, component``.

    Urls that differ only in scheme, ``www.``, fragment, tracking parameters or a closing slash are one
    node. Nodes are joined by the canonical and refresh links in ``html`` (None: not read) and by
    ``redirects(from_url, to_url)``; components spread over executors. A url under a rule keeps the
    rule's verdict. Any other is blocked if its component holds a blocked url and no explicitly allowed
    one, else allowed. Null urls and urls without ``://`` have empty host and path, no component, and
    are allowed. Repeated rows stay; columns named like a result are replaced by it.
    """
    named = ("host", "path", "rule", "verdict", "component")
    host, path = host_and_path(F.col(url))
    # the pages' own columns travel in a struct, so that none can clash with those of the work
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    judged = pages.select(row.alias("row"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "verdict": verdict, "_node": canonical_url(F.col("url"))})
    links = []
    if html is not None and html in pages.columns:
        links.append(page_links(pages, url, html))
    if redirects is not None:
        links.append(redirects.select(canonical_url(F.col("from_url")).alias("a"), canonical_url(F.col("to_url")).alias("b")))
    if links:
        edges = links[0]
        for more in links[1:]:
            edges = edges.union(more)
        of = components(edges).select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        judged = judged.join(of, F.col("_node") == F.col("_id"), "left").drop("_id")
        judged = judged.withColumn("component", F.coalesce("_component", "_node")).drop("_component")
    else:
        judged = judged.withColumn("component", F.col("_node"))
    ruled = judged.where(F.col("verdict").isNotNull()).groupBy("component").agg(
        F.max(F.col("verdict") == "allow").alias("_allow"), F.max(F.col("verdict") == "block").alias("_block")
    )
    spread = ruled.where("_block and not _allow").select(unplaced(F.col("component"), "string").alias("_id"))
    judged = judged.join(spread, F.col("component") == F.col("_id"), "left")
    aliased = F.when(F.col("_id").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    judged = judged.withColumn("verdict", F.coalesce("verdict", aliased))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c not in named], *named)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


#: The pages hold no canonical or refresh links, so aliases are urls of one node.
OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, url,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM cut),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN host = '' THEN NULL ELSE
      regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www[.]', '')
      || regexp_replace(path, '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') END AS node
  FROM parts),
verdicts AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM ruled),
spread AS (
  SELECT node FROM verdicts WHERE node IS NOT NULL GROUP BY node HAVING bool_or(own = 'block') AND NOT bool_or(own = 'allow'))
SELECT page_id, host, path, rule,
       coalesce(own, CASE WHEN node IN (SELECT node FROM spread) THEN 'block' ELSE 'allow' END) AS verdict
FROM verdicts
"""
