"""URL filter: rules by longest match, block decisions spread over redirect and canonical links.

Pages and link targets are nodes (host, path and query; scheme and fragment do not count).
Links come from every ``<link href>`` whose ``rel`` has the token ``canonical`` and every
``<meta http-equiv=refresh>``, outside comments and of scripts, styles, titles and text areas;
references are resolved as RFC 3986 has it, against ``<base href>`` if there is one, and dot
segments are removed from all nodes. Connected components are found on the linked nodes alone. A page with a rule of its own keeps the rule's
verdict, so an explicit allow beats a block elsewhere in its component; a page without one is
blocked if any node of its component has a block rule, and allowed otherwise.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no
node and verdict allow; a null html has no links; each row is judged by itself, repeated rows
alike; an empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import Scratch, table
from chunkloom.llm.components import connected_components
from chunkloom.llm.decontaminate import ascii_lower

#: (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), none, step)
    last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))).otherwise(path)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: the optimizer would write them out again at each of their uses, and does not across an exploded array of one."""
    one = df.withColumn("__cl_bound", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return one.select(*df.columns, *[F.col(f"__cl_bound.{n}").alias(n) for n in columns])


def with_node(df: DataFrame, url: str, name: str) -> DataFrame:
    """Add host, path without dot segments, and query of a url column; null without ``://``."""
    d = bound(df, __cl_rest=F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1))
    path = F.regexp_extract("__cl_rest", r"^([^?]*)", 1)
    d = bound(d, __cl_path=F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    node = F.concat(host_of(F.col(url)), without_dots(F.col("__cl_path")), F.regexp_extract("__cl_rest", r"^[^?]*(.*)$", 1))
    return bound(d, **{name: F.when(F.instr(url, "://") > 0, node)}).select(*df.columns, name)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits (host/path), or null."""
    found = F.lit(None).cast("string")
    for _, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, F.lit(r)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for v, r in rules:
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


#: What holds no tags: comments and elements of text.
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<textarea\b.*?</textarea\s*>"
_TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""(?s)[^\s=>"'/<]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_VALUE = r"(?s)=\s*(.*)$"
#: The target in the content of a refresh.
_TARGET = r"""(?is)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)"""


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of this name, or an empty string."""
    mine = F.get(F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)) == name), F.lit(0))
    value = F.btrim(F.regexp_extract(mine, _VALUE, 1), F.lit("\"'"))
    for entity in ("&amp;", "&#38;", "&#x26;"):
        value = F.replace(value, F.lit(entity), F.lit("&"))
    return F.coalesce(F.trim(value), F.lit(""))


def resolve(base: Column, ref: Column) -> Column:
    """An absolute URL from a reference found on page ``base``; ``with_node`` removes its dot segments."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    origin = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    folder = F.when(folder.rlike("://[^/]*$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), ref))
        .when(ref.startswith("#") | (ref == ""), base)
        .otherwise(F.concat(folder, ref))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): the node of a page and each node that it redirects to or names as canonical."""
    low = F.lower(F.col("html"))
    p = pages.select("url", "html").filter(F.col("url").contains("://") & (low.contains("canonical") | low.contains("refresh")))
    tags = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, ""), F.lit(_TAG), F.lit(0))
    p = bound(p, tags=tags).filter(F.size("tags") > 0).drop("html")
    parsed = F.transform("tags", lambda t: F.struct(F.lower(F.substring(t, 2, 4)).alias("kind"), F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(0)).alias("a")))
    p = bound(p, parsed=parsed).drop("tags")
    based = F.get(F.filter("parsed", lambda t: (t["kind"] == "base") & (_attribute(t["a"], "href") != "")), F.lit(0))
    p = bound(p, named=_attribute(based["a"], "href"))
    p = bound(p, base=F.when(F.coalesce("named", F.lit("")) != "", resolve(F.col("url"), F.col("named"))).otherwise(F.col("url")))
    p = p.select("url", "base", F.explode("parsed").alias("t"))
    a = F.col("t.a")
    p = bound(p, kind=F.col("t.kind"), rel=F.lower(_attribute(a, "rel")), equiv=F.lower(_attribute(a, "http-equiv")), href=_attribute(a, "href"), content=_attribute(a, "content"))
    canonical = (F.col("kind") == "link") & F.array_contains(F.split("rel", r"\s+"), "canonical")
    refresh = (F.col("kind") == "meta") & (F.col("equiv") == "refresh")
    ref = F.when(canonical, F.col("href")).when(refresh, F.trim(F.regexp_extract("content", _TARGET, 1)))
    p = bound(p, ref=ref).filter("ref <> ''")
    p = bound(p, target=resolve(F.col("base"), F.col("ref"))).select("url", "target")
    return with_node(with_node(p, "url", "u"), "target", "v").select("u", "v").filter("u is not null and v is not null")


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component (null for a page without links)."""
    scratch = Scratch(pages.sparkSession)
    cc = connected_components(link_edges(pages), scratch)
    host, path = F.split_part(F.col("node"), F.lit("/"), F.lit(1)), F.regexp_extract("node", r"^[^/]*([^?]*)", 1)
    cc = cc.withColumn("blocks", (verdict_of(rule_of(host, path, rules), rules) == "block").cast("int"))
    blocked = cc.groupBy("component").agg(F.max("blocks").alias("blocked"))
    cc = scratch.keep(cc.select("node", "component").join(blocked, "component"))
    p = with_node(pages.select("page_id", "url"), "url", "node")
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "node").join(cc, "node", "left")
    p = bound(p, rule=rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("blocked") == 1, "block").otherwise("allow")
    return p.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), method).alias("verdict"), "component")


def op4_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op4_redirect_filter": op4_redirect_filter}

_RULE_SQL = "CASE " + " ".join(
    f"WHEN ({{h}} = '{r.partition('/')[0]}' OR ends_with({{h}}, '.{r.partition('/')[0]}')) AND starts_with({{p}}, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda x: -len(x[1]))
) + " END"
_VERDICT_SQL = "CASE {r} " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES) + " END"
_LOWER_SQL = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST_SQL = _LOWER_SQL.format(x="regexp_extract({u}, '://([^/?#]*)', 1)")
_DOTS_SQL = """CASE WHEN contains({p}, '/.') THEN '/' || array_to_string(list_reduce(list_prepend(CAST(['/'] AS VARCHAR[]), list_transform(string_split({p}, '/')[2:], lambda s: [s])),
  lambda a, s: CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE a || s END)[2:]
  || CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END, '/') ELSE {p} END"""
_REST_SQL = "regexp_extract({u}, '://[^/?#]*([^#]*)', 1)"
_PATH_SQL = f"(CASE WHEN starts_with({_REST_SQL}, '/') THEN '' ELSE '/' END || regexp_extract({_REST_SQL}, '^([^?]*)', 1))"
_NODE_SQL = "CASE WHEN contains({u}, '://') THEN " + _HOST_SQL + " || " + _DOTS_SQL.format(p=_PATH_SQL) + f" || regexp_extract({_REST_SQL}, '^[^?]*(.*)$', 1) END"
_ATTRIBUTE_SQL = r"""coalesce(trim(replace(replace(replace(trim(regexp_extract(list_filter({a}, lambda x: lower(regexp_extract(x, '^([^\s=]+)', 1)) = '{name}')[1], '(?s)=\s*(.*)$', 1), '"' || chr(39)), '&amp;', '&'), '&#38;', '&'), '&#x26;', '&')), '')"""
_RESOLVE_SQL = r"""CASE WHEN regexp_matches({r}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {r}
  WHEN starts_with({r}, '//') THEN regexp_extract({b}, '^([^:/?#]*):', 1) || ':' || {r}
  WHEN starts_with({r}, '/') THEN regexp_extract({b}, '^([^:/?#]*://[^/?#]*)', 1) || {r}
  WHEN starts_with({r}, '?') THEN regexp_extract({b}, '^([^?#]*)', 1) || {r}
  WHEN starts_with({r}, '#') OR {r} = '' THEN {b}
  ELSE regexp_replace(regexp_extract({b}, '^([^:/?#]*://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1), '(://[^/]*)$', '\1/') || {r} END"""


def _quoted(pattern: str) -> str:
    """A pattern as an SQL string, without the possessive marks that RE2 doesn't know."""
    return "'" + pattern.replace("++", "+").replace("*+", "*").replace("'", "''") + "'"


ORACLE_SQL = {
    "op4_redirect_filter": f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce({_HOST_SQL.format(u="url")}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, {_NODE_SQL.format(u="url")} AS node FROM pages),
tags AS (SELECT node, url, list_transform(regexp_extract_all(regexp_replace(html, {_quoted(_HIDDEN)}, '', 'g'), {_quoted(_TAG)}),
    lambda t: {{'kind': lower(t[2:5]), 'a': regexp_extract_all(t, {_quoted(_ATTRIBUTE)})}}) AS tags FROM p WHERE node IS NOT NULL AND html IS NOT NULL),
based AS (SELECT node, tags, url, coalesce(list_filter(list_transform(tags, lambda t: CASE WHEN t.kind = 'base' THEN {_ATTRIBUTE_SQL.format(a="t.a", name="href")} ELSE '' END), lambda x: x <> '')[1], '') AS b FROM tags),
one AS (SELECT node, CASE WHEN b = '' THEN url ELSE {_RESOLVE_SQL.format(r="b", b="url")} END AS base, unnest(tags) AS t FROM based),
refs AS (SELECT node AS u, base, CASE
  WHEN t.kind = 'link' AND list_contains(regexp_split_to_array(lower({_ATTRIBUTE_SQL.format(a="t.a", name="rel")}), '\\s+'), 'canonical') THEN {_ATTRIBUTE_SQL.format(a="t.a", name="href")}
  WHEN t.kind = 'meta' AND lower({_ATTRIBUTE_SQL.format(a="t.a", name="http-equiv")}) = 'refresh' THEN trim(regexp_extract({_ATTRIBUTE_SQL.format(a="t.a", name="content")}, {_quoted(_TARGET)}, 1))
  ELSE '' END AS ref FROM one),
targets AS (SELECT u, {_RESOLVE_SQL.format(r="ref", b="base")} AS target FROM refs WHERE ref <> ''),
e AS (SELECT u, {_NODE_SQL.format(u="target")} AS v FROM targets WHERE contains(target, '://')),
both_ways AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach(u, v) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u),
cc AS (SELECT u AS node, min(v) AS component,
  bool_or({_VERDICT_SQL.format(r="(" + _RULE_SQL.format(h="split_part(v, '/', 1)", p="regexp_extract(v, '^[^/]*([^?]*)', 1)") + ")")} = 'block') AS blocked
  FROM reach GROUP BY u)
SELECT page_id, host, path, rule, coalesce({_VERDICT_SQL.format(r="rule")}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, component
FROM (SELECT p.*, {_RULE_SQL.format(h="host", p="path")} AS rule, cc.component, cc.blocked FROM p LEFT JOIN cc ON p.node = cc.node)"""
}
