"""URL filters: host and path rules, and redirect equivalence that carries block decisions to aliases.

Pages are nodes by address. Edges are `<link rel=canonical>` and `<meta http-equiv=refresh>` targets and rows of a
redirect table, if there is one. All of it is DataFrame work; components come from star rounds over the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.plan import connected_components

#: (verdict, host, path): fixed values of the default rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Entities of an attribute and what they stand for; the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = (r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
_REFRESH = (r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host with A-Z lower-cased, and the path; both empty where there is none."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.substring_index(F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit("")), "#", 1), "?", 1)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring_index(rest, "/", 1)).otherwise(rest)
    path = F.when(slash > 0, F.regexp_extract(rest, r"(?s)^[^/]*(/.*)$", 1)).otherwise(F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict); null if none does. Rules are few literals."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def resolved(base: Column, target: Column) -> Column:
    """A link's target as an address: entities decoded, relative ones against the page's address; null for none or a fragment."""
    t = F.trim(target)
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    origin = F.regexp_extract(base, r"(?s)^[^:]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")

    def plain(whole: Column) -> Column:
        """A path without its dots, and what follows it."""
        parts = F.split(F.regexp_replace(F.regexp_extract(whole, r"(?s)^[^?#]*", 0), "^/", ""), "/", -1)
        step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), x))
        return F.concat(F.aggregate(parts, F.lit(""), step), F.regexp_extract(whole, r"(?s)[?#].*$", 0))

    relative = (
        F.when(t.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^[^:]*:", 0), t))
        .when(t.startswith("/"), F.concat(origin, plain(t)))
        .when(t.startswith("?"), F.concat(origin, path, t))
        .otherwise(F.concat(origin, plain(F.concat(folder, t))))
    )
    return F.when((t == "") | t.startswith("#"), None).when(F.instr(t, "://") > 0, t).when(F.instr(base, "://") > 0, relative)


def link_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(a, b): a page's address and each address that it names as canonical or redirects to."""
    found = [_targets(F.col(html_col), tag, target) for tag, target in (_CANONICAL, _REFRESH)]
    each = pages.where(F.col("__url").isNotNull() & F.col(html_col).isNotNull()).select(F.col("__url").alias("a"), F.explode(F.concat(*found)).alias("t"))
    return each.select("a", resolved(F.col("a"), F.col("t")).alias("b")).where("b IS NOT NULL")


def _targets(html: Column, tag: str, target: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, target, 1))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict) of every page.

    A page with a rule has the rule's verdict, so an explicit allow holds whatever its aliases are. One without is blocked
    if any address of its component is blocked by a rule, and allowed otherwise. Component: addresses that canonical
    links, refreshes or rows (from_url, to_url) of redirects connect, in any direction; every such tag of a page counts,
    relative targets are resolved against its address, and targets that are no page count. A
    null url has an empty host and path, no rule and no edge; null html has no edge. Pages with one address are aliases.
    Other columns are ignored. An empty table gives an empty one.
    """
    base = pages.select(F.col(id_col), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    edges = link_edges(base, "__html")
    if redirects is not None:
        edges = edges.union(redirects.select("from_url", "to_url").where("from_url IS NOT NULL AND to_url IS NOT NULL"))

    def judged(df: DataFrame) -> DataFrame:
        host, path = host_path(F.col("__url"))
        df = df.withColumns({"host": host, "path": path})
        return df.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules))

    groups = connected_components(edges)
    nodes = judged(groups.select(F.col("node").alias("__url"), "component"))
    blocked = nodes.groupBy("component").agg(F.max(F.col("__best.verdict") == "block").alias("blocked")).where("blocked")
    alias = nodes.join(blocked, "component").select(F.col("__url").alias("__node"))
    out = judged(base.select(id_col, "__url")).join(alias, F.col("__url") == F.col("__node"), "left")
    verdict = F.coalesce(F.col("__best.verdict"), F.when(F.col("__node").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(id_col, "host", "path", F.col("__best.rule").alias("rule"), verdict.alias("verdict"))


def _judged_sql(name: str, source: str, columns: str) -> str:
    """CTEs that end in <name>: host, path and rule of each url of source."""
    return rf"""
{name}_p AS (SELECT {columns}, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest FROM {source}),
{name}_h AS (SELECT {columns}, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/]*(/.*)$', 1, 's') AS path FROM {name}_p),
{name} AS (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM {name}_h)"""


_EDGES = r"""
g AS (SELECT url, unnest(list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
    || list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS t FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
q AS (SELECT url, replace(replace(replace(replace(replace(trim(t), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t, regexp_extract(url, '(?s)^[^:]*://[^/?#]*') AS origin, regexp_extract(url, '(?s)^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM g),
w AS (SELECT *, CASE WHEN starts_with(t, '/') THEN t ELSE regexp_replace(path, '[^/]*$', '') || t END AS whole FROM q),
z AS (SELECT *, list_reduce(list_prepend('', string_split(regexp_replace(regexp_extract(whole, '(?s)^[^?#]*'), '^/', ''), '/')), lambda acc, x: CASE x WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END) || regexp_extract(whole, '(?s)[?#].*$') AS dotless FROM w),
e AS (SELECT url AS a, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN instr(t, '://') > 0 THEN t WHEN instr(url, '://') = 0 THEN NULL WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^[^:]*:') || t WHEN starts_with(t, '?') THEN origin || path || t ELSE origin || dotless END AS b FROM z)"""
ORACLE = f"""
WITH RECURSIVE {_judged_sql("r", "pages", "page_id, url")}, {_EDGES},
b AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
c(node, seen) AS (SELECT a, a FROM b UNION SELECT c.node, b.b FROM c JOIN b ON c.seen = b.a),
n AS (SELECT DISTINCT a AS url FROM b), {_judged_sql("m", "n", "url")},
k AS (SELECT DISTINCT c.node FROM c JOIN m ON m.url = c.seen WHERE m.rule IN ('net/', 'example.com/de/'))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN url IN (SELECT node FROM k) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
