"""URL filters by rules on hosts and paths, and by redirect equivalence.

A rule decides the urls that it fits. The decision to block also reaches the aliases of a blocked url: the urls that are
linked with it by redirects and canonical links, over any number of steps. Such links come from the pages themselves
(<link rel=canonical>, <meta http-equiv=refresh>) and from a table of redirects, if one is given. An explicit allow has
precedence: a url's own rule always stands, and a group of aliases that holds an allowed url passes no block on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import spread, table, written
from quillmark.llm.components import components

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules that become one expression; a longer list is a table (fit_table).
MOST_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Patterns that the SQL shares.
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>"
LINK, META = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
CANONICAL, REFRESH = r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF, TARGET = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def _part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, n), F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is none."""
    return F.translate(_part(url, 2), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def node_of(url: Column) -> Column:
    """The url as a node of the alias graph: scheme and host lower-cased, no fragment; null where it has no ://."""
    text = F.concat(F.translate(_part(url, 1), _UPPER, _LOWER), F.lit("://"), host_of(url), path_of(url), _part(url, 4))
    return F.when(F.contains(url, F.lit("://")), text)


def fit_list(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null: one expression over (verdict, host, path) rules."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are too many for one expression; give them as a table")
    found = []
    for verdict, h, p in rules:
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found.append(F.when(fits, F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def fit_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(node, host, path) with rule and verdict from rules(verdict, host, path) of any number.

    Hosts meet rules by equality on each of their suffixes, paths on their beginnings of the lengths that the host's rules
    have; so a host with very many rules costs a url one key for each length, not a row for each rule. node tells urls apart.
    """
    rules = rules.select("verdict", F.col("host").alias("h"), F.col("path").alias("p")).dropDuplicates(["h", "p"])
    lengths = rules.groupBy("h").agg(F.collect_set(F.length("p")).alias("sizes"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.select("node", "path", F.explode(suffixes).alias("h")).join(lengths, "h")
    tried = keyed.select("node", "h", "path", F.explode("sizes").alias("size")).where(F.length("path") >= F.col("size")).select("node", "h", F.expr("substring(path, 1, size)").alias("p"))
    size = F.length("h") + F.length("p")
    best = F.max(F.struct(size.alias("size"), F.concat("h", "p").alias("rule"), "verdict")).alias("best")
    fit = tried.join(rules, ["h", "p"]).groupBy("node").agg(best).select("node", "best.rule", "best.verdict")
    return urls.join(fit, "node", "left")


def resolved(base: Column, href: Column) -> Column:
    """The url that href names on the page base; null for other schemes. Dot segments stay as they are written."""
    scheme, root, path = _part(base, 1), F.concat(_part(base, 1), F.lit("://"), host_of(base)), path_of(base)
    folder = F.regexp_replace(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.lit("/")), r"[^/]*$", "")
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href)).when(F.startswith(href, F.lit("#")), base).when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None)).otherwise(F.concat(root, folder, href))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """a, b: the nodes of pages(url, html) and of their first canonical link and first refresh. Comments and scripts don't count."""
    marked = pages.where(F.contains("url", F.lit("://")) & F.rlike("html", F.lit("(?i)canonical|refresh")))
    shown = marked.select("url", F.regexp_replace("html", HIDDEN, "").alias("html"))
    pick = lambda tags, kind, value: F.nullif(F.regexp_extract(F.coalesce(F.get(F.filter(F.regexp_extract_all("html", F.lit(tags), F.lit(0)), lambda t: F.rlike(t, F.lit(kind))), F.lit(0)), F.lit("")), value, 1), F.lit(""))
    found = shown.select("url", F.explode(F.array_compact(F.array(pick(LINK, CANONICAL, HREF), pick(META, REFRESH, TARGET)))).alias("href"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.replace("href", F.lit("&amp;"), F.lit("&")))).alias("b"))


def _ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls(node, ..) with host, path, rule and verdict by its rule."""
    placed = urls.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node")))
    if isinstance(rules, DataFrame):
        return fit_table(placed, rules)
    return placed.withColumn("fit", fit_list(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("fit.rule")).withColumn("verdict", F.col("fit.verdict")).drop("fit")


def blocked_aliases(links: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """node of all urls in groups of links(a, b) that hold a blocked url and no allowed one."""
    members = written(components(links, "aliases"), "alias-members")
    ruled = _ruled(members.select("node", "root"), rules)
    groups = ruled.groupBy("root").agg(F.max(F.col("verdict") == "block").alias("blocks"), F.max(F.col("verdict") == "allow").alias("allows"))
    bad = groups.where("coalesce(blocks, false) AND NOT coalesce(allows, false)").select("root")
    return members.join(bad, "root", "left_semi").select("node")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages(page_id, url, html, ..).

    rules are (verdict, host, path); a rule fits its host and all subdomains where the path starts with its own, and the
    longest wins, by host and path together. A url that no rule fits is blocked if its group of aliases holds a blocked url
    and no allowed one, else allowed. redirects(from_url, to_url) add to the pages' own links. A null url, or one without
    ://, has an empty host and path and no aliases; null html has no links. Rows that repeat, or share an id or a url, are
    judged each. An empty table gives no rows; further columns play no part.
    """
    rows = spread(pages, "page_id", "url", "html")
    links = page_links(rows)
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    found = written(links, "alias-links")
    judged = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    if isinstance(rules, DataFrame):
        named = _ruled(judged.where("node IS NOT NULL").select("node").distinct(), rules).select("node", "rule", "verdict")
        judged = judged.join(named, "node", "left")
    else:
        judged = judged.withColumn("fit", fit_list(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "node", "fit.rule", "fit.verdict")
    bad = blocked_aliases(found, rules).distinct().withColumn("bad", F.lit(True))
    judged = judged.join(bad, "node", "left")
    verdict = F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def allowed_pages(pages: DataFrame, **how) -> DataFrame:
    """The rows of pages that filter_urls allows, with their columns; rows that share an id go if one of them is blocked, null ids stay."""
    bad = filter_urls(pages, **how).where("verdict = 'block'").select(F.col("page_id").alias("_id")).distinct()
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    return rows.join(bad, F.col("row.page_id") == F.col("_id"), "left_anti").select(*[F.col(f"row.`{c}`") for c in pages.columns])


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_urls over all pages with the query's rules; nulls, ties and odd rows as stated there."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_part(url: str, n: int) -> str:
    return f"coalesce(regexp_extract({url}, {_q(PARTS)}, {n}), '')"


def _sql_low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _sql_host(url: str) -> str:
    return _sql_low(_sql_part(url, 2))


def _sql_node(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN {_sql_low(_sql_part(url, 1))} || '://' || {_sql_host(url)} || {_sql_part(url, 3)} || {_sql_part(url, 4)} END"


def _sql_fit(host: str, path: str, key: str, source: str) -> str:
    return f"SELECT {key}, arg_max(struct_pack(rule := h || p, verdict := v), length(h || p)) AS fit FROM {source}, rules WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p) GROUP BY {key}"


def _sql_pick(tags: str, kind: str, value: str) -> str:
    return f"nullif(regexp_extract(list_filter(regexp_extract_all(html, {_q(tags)}), lambda t: regexp_matches(t, {_q(kind)}))[1], {_q(value)}, 1), '')"


_ROOT = f"{_sql_part('url', 1)} || '://' || {_sql_host('url')}"
SQL = f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
judged AS (SELECT row_number() OVER () AS k, page_id, url, html, {_sql_host("url")} AS host, {_sql_part("url", 3)} AS path, {_sql_node("url")} AS node FROM pages),
shown AS (SELECT url, node, path, regexp_replace(html, {_q(HIDDEN)}, '', 'g') AS html FROM judged WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
hrefs AS (SELECT url, node, path, replace(unnest([{_sql_pick(LINK, CANONICAL, HREF)}, {_sql_pick(META, REFRESH, TARGET)}]), '&amp;', '&') AS href FROM shown),
named AS (SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN {_sql_part("url", 1)} || ':' || href
  WHEN starts_with(href, '/') THEN {_ROOT} || href WHEN starts_with(href, '?') THEN {_ROOT} || path || href WHEN starts_with(href, '#') THEN url
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE {_ROOT} || regexp_replace(CASE WHEN starts_with(path, '/') THEN path ELSE '/' END, '[^/]*$', '') || href END AS aim FROM hrefs WHERE href IS NOT NULL),
edges AS (SELECT DISTINCT node AS a, {_sql_node("aim")} AS b FROM named WHERE {_sql_node("aim")} IS NOT NULL),
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
far AS (SELECT DISTINCT b AS node, {_sql_host("b")} AS host, {_sql_part("b", 3)} AS path FROM reach),
fit_far AS ({_sql_fit("host", "path", "node", "far")}),
bad AS (SELECT a AS node FROM reach LEFT JOIN fit_far ON reach.b = fit_far.node GROUP BY a HAVING coalesce(bool_or(fit.verdict = 'block'), false) AND NOT coalesce(bool_or(fit.verdict = 'allow'), false)),
fit_own AS ({_sql_fit("host", "path", "k", "judged")})
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN fit_own USING (k) LEFT JOIN bad ON judged.node = bad.node
"""
