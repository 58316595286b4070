"""URL filter with redirect equivalence (operator 5, DataFrame only).

Rules judge (host, path); the longest fitting rule wins. Pages that no rule
fits inherit a decision from their aliases: redirect (``meta refresh``) and
canonical-link edges, plus any redirect log given as ``edges``, form a graph
of URLs whose connected components are found by distributed label
propagation. A component with a blocked member blocks its undecided members,
unless a member is explicitly allowed (an allow takes precedence). A page
with a rule of its own always keeps that rule's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import components, materialize, read_table

#: (verdict, host, path) of the contract query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Lists up to this length are applied inside one expression; longer ones, and
#: rules given as a table, are joined on the host's suffixes, with the same result.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)(<link\s[^>]*\brel\s*=\s*[\x22']?canonical\b[^>]*>)"
_HREF = r"(?is)\bhref\s*=\s*[\x22']?([^\x22'>\s]+)"
_META = r"(?is)(<meta\s[^>]*\bhttp-equiv\s*=\s*[\x22']?refresh\b[^>]*>)"
_GOTO = r"(?is)\burl\s*=\s*[\x22']?([^\x22'>\s]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
    empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end (may be empty)."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _by_precedence(rule: tuple) -> tuple:
    """Sort key: the rule that wins comes first. The longest host and path
    together win; of these the longer host; of equal rules allow."""
    verdict, h, p = rule
    return -len(h + p), -len(h), verdict != "allow", h, p


def apply_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the rule that wins; null if none fits. A rule
    fits its host and all subdomains if the path starts with its path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=_by_precedence, reverse=True):  # the last one here is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(spark: SparkSession, rows: DataFrame, rules=RULES) -> DataFrame:
    """``rows(host, path, ...)`` with ``own``, the struct of :func:`apply_rules`.
    ``rules`` is a list of (verdict, host, path) or a table of these columns;
    nulls in a table make a rule void.

    A long list is joined: the rules of one host are one row, in their order;
    a URL's host is spread into its suffixes, one of which meets them. Each
    distinct (host, path) is judged once, so that a host of many pages is no
    larger than its paths."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            return rows.withColumn("own", apply_rules(F.col("host"), F.col("path"), rules))
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    size = -F.length("host") - F.length("path")
    order = F.struct(size.alias("a"), (-F.length("host")).alias("b"), (F.col("verdict") != "allow").alias("c"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    table = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").groupBy(F.col("host").alias("rule_host")).agg(
        F.array_sort(F.collect_list(order)).alias("rules"))
    each = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = each.select("host", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host")
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["p"])), 0)
    met = met.select("host", "path", "rule_host", first.alias("r")).where("r IS NOT NULL")
    best = met.groupBy("host", "path").agg(F.min(F.struct("r.a", "r.b", "r.c", F.concat("rule_host", "r.p").alias("rule"), "r.v")).alias("m"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.struct(F.col("m.rule").alias("rule"), F.col("m.v").alias("verdict")).alias("own"))
    return rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


def node_of(url: Column) -> Column:
    """The URL as a graph node: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def _absolute(base: Column, link: Column) -> Column:
    """``link`` against the page's URL: full, ``//host``, ``/path`` or relative to the folder."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    folder = F.regexp_replace(F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base)), r"[^/]*$", "")
    return (F.when(F.coalesce(link, F.lit("")) == "", F.lit(None))
            .when(link.contains("://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host_of(base), link))
            .when(link.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))
            .otherwise(F.concat(scheme, F.lit("://"), host_of(base), folder, link)))


def page_edges(pages: DataFrame) -> DataFrame:
    """Alias edges (from_url, to_url) out of ``pages(url, html)``: canonical
    links and meta refreshes. Pages without them cost one substring test."""
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    low = F.lower(html)
    canon = F.when(low.contains("canonical"), F.regexp_extract(F.regexp_extract(html, _LINK, 1), _HREF, 1))
    goto = F.when(low.contains("refresh"), F.regexp_extract(F.regexp_extract(html, _META, 1), _GOTO, 1))
    found = pages.where(url.contains("://") & (low.contains("canonical") | low.contains("refresh"))).select(
        url.alias("from_url"), F.explode(F.array(_absolute(url, canon), _absolute(url, goto))).alias("to_url"))
    return found.where(F.coalesce(F.col("to_url"), F.lit("")).contains("://"))


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, host, path,
    rule (null if none fits), verdict, component (null if the page has no
    alias). ``rules`` is a list or a table (see :func:`with_rule`), of any
    size; ``edges(from_url, to_url)`` adds a redirect log.

    Null, empty or malformed URLs have empty host and path, no aliases, and
    are allowed unless a rule fits. Null html has no links; html of any length
    is searched whole, and its first canonical link and first refresh count.
    Of rules that fit equally the longer host wins, then allow. Repeated pages
    each get their row. Other columns are ignored. An empty table gives an
    empty result.
    """
    found = page_edges(pages.select("url", "html"))
    if edges is not None:
        found = found.union(edges.select("from_url", "to_url").where(
            F.col("from_url").contains("://") & F.col("to_url").contains("://")))
    links = materialize(spark, found.select(
        node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"), "from_url", "to_url"), "aliases")
    base = pages.select(F.col("page_id"), F.col("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = base.select("page_id", "url", host.alias("host"), path.alias("path"))
    base = with_rule(spark, base, rules)
    if links.isEmpty():
        return base.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                           F.coalesce("own.verdict", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("string").alias("component"))
    comp = components(spark, links.select("a", "b"))
    ends = links.select(F.col("a").alias("node"), F.col("from_url").alias("u")).union(
        links.select("b", "to_url")).distinct()
    ends = ends.select("node", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    ends = with_rule(spark, ends, rules).select("node", F.col("own.verdict").alias("v"))
    votes = ends.groupBy("node").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
    # a link from a page to itself has no component row; it is its own
    nodes = materialize(spark, votes.join(comp, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("component"), "allow", "block"), "alias-votes")
    seen = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)))
    verdicts = materialize(spark, nodes.groupBy("component").agg(
        (seen("block") & ~seen("allow")).alias("blocked")), "component-verdicts")
    nodes = materialize(spark, nodes.select("node", "component").join(verdicts, "component"), "node-verdicts")
    key = F.when(F.col("url").contains("://"), node_of(F.col("url")))
    out = base.withColumn("node", key).join(nodes, "node", "left")
    alias = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                      F.coalesce("own.verdict", alias).alias("verdict"), "component")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``pages`` table."""
    return judge(spark, read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _rule_case(host: str, path: str, field: int) -> str:
    out = "CASE"
    for r in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        value = (r[1] + r[2], r[0])[field]
        out += f" WHEN ({host} = '{r[1]}' OR ends_with({host}, '.{r[1]}')) AND starts_with({path}, '{r[2]}') THEN '{value}'"
    return out + " END"


_H = "translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), '" + _UPPER + "', '" + _LOWER + "')"
_P = "regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_N = _H + " || CASE WHEN {r} = '' THEN '/' ELSE {r} END"
_R = "regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1)"


def _abs(link: str) -> str:
    """DuckDB SQL of :func:`_absolute` for a link of the page's columns url, host and path."""
    scheme = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    folder = "regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '')"
    return (f"CASE WHEN {link} = '' THEN NULL WHEN contains({link}, '://') THEN {link} WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link} "
            f"WHEN starts_with({link}, '/') THEN {scheme} || '://' || host || {link} WHEN regexp_matches({link}, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL "
            f"ELSE {scheme} || '://' || host || {folder} || {link} END")


def _n(u: str) -> str:
    return _N.format(u=u, r=_R.format(u=u))


OP5_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {_H.format(u='url')} AS host, {_P.format(u='url')} AS path, {_n('url')} AS node,
         replace(regexp_extract(regexp_extract(coalesce(html, ''), '(?is)(<link\s[^>]*\brel\s*=\s*[\x22\x27]?canonical\b[^>]*>)', 1),
                 '(?is)\bhref\s*=\s*[\x22\x27]?([^\x22\x27>\s]+)', 1), '&amp;', '&') AS c,
         replace(regexp_extract(regexp_extract(coalesce(html, ''), '(?is)(<meta\s[^>]*\bhttp-equiv\s*=\s*[\x22\x27]?refresh\b[^>]*>)', 1),
                 '(?is)\burl\s*=\s*[\x22\x27]?([^\x22\x27>\s]+)', 1), '&amp;', '&') AS g
  FROM pages),
l AS (SELECT url AS from_url, {_abs('c')} AS to_url FROM p WHERE contains(url, '://') AND contains({_abs('c')}, '://')
      UNION SELECT url, {_abs('g')} FROM p WHERE contains(url, '://') AND contains({_abs('g')}, '://')),
e AS (SELECT {_n('from_url')} AS a, {_n('to_url')} AS b FROM l),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach AS (SELECT a AS node, b AS other FROM b UNION SELECT r.node, b.b FROM reach r JOIN b ON r.other = b.a),
u AS (SELECT from_url AS url FROM l UNION SELECT to_url FROM l),
v AS (SELECT {_n('url')} AS node, {_rule_case(_H.format(u='url'), _P.format(u='url'), 1)} AS verdict FROM u),
s AS (SELECT r.node, bool_or(v.verdict = 'block') AND NOT coalesce(bool_or(v.verdict = 'allow'), false) AS blocked
      FROM reach r JOIN v ON r.other = v.node GROUP BY r.node)
SELECT page_id, host, path, {_rule_case('host', 'path', 0)} AS rule,
       coalesce({_rule_case('host', 'path', 1)}, CASE WHEN s.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s ON s.node = p.node AND contains(p.url, '://')
"""
