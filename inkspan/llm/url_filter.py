"""URL rules with redirect equivalence.

Redirects and canonical links join urls that name one resource; connected components of those edges carry a block
from one alias to the others. A rule that fits a url itself always decides it, and an explicit allow anywhere in a
component takes precedence over blocks there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, ascii_lower, cut, let, table
from .components import connected_components

#: The rules of the query, (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Links are looked for in the head's tags only, so matches end early on long pages. rel is a list of words.
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*(?:\"[^\">]*(?<![^\s\"])canonical(?![^\s\"])|'[^'>]*(?<![^\s'])canonical(?![^\s'])|canonical[\s>/]))[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"
_BASE = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host or its parent domains and the path's beginning; nulls if none."""
    name = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, r).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def node(url: Column) -> Column:
    """What identifies a resource: host, path and query, without scheme and fragment; null where there is no host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def _without_dots(path: Column) -> Column:
    """A path whose . and .. segments are taken away, as far up as the root."""
    def step(acc, part):
        return F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    out = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    closed = let(out, lambda x: F.when(path.rlike(r"/\.\.?$") & (x != "/"), F.concat(x, F.lit("/"))).otherwise(x))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), closed).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """A link, with &amp; for &, as an absolute url by its page's: absolute as it is, //host/..., /path, ?query, and
    paths relative to the page's; null where the page has no host. Links to a place in the page (#) are the page."""
    parts = F.struct(F.regexp_replace(link, "(?i)&amp;|&#38;|&#x26;", "&").alias("link"), host_of(base).alias("host"), path_of(base).alias("path"), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^#]*)", 1).alias("here"))
    return let(parts, lambda x: _resolved(x["link"], x["host"], x["path"], x["here"]))


def _resolved(link: Column, host: Column, path: Column, here: Column) -> Column:
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    target = F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(path, link)).when(link.startswith("#"), here).otherwise(F.concat(folder, link))
    at = let(target, lambda t: F.concat(let(F.regexp_extract(t, r"(?s)^([^?#]*)", 1), _without_dots), F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1)))
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link)).when(host != "", F.concat(F.lit("http://"), host, at))


def _links_in(head: Column) -> Column:
    return F.filter(F.concat(F.regexp_extract_all(head, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(head, F.lit(_REFRESH), F.lit(1))), lambda x: x != "")


def _own_base(head: Column) -> Column:
    return F.regexp_extract(head, _BASE, 1)


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b): the nodes of a page and of each page that its canonical links or refreshes name, read by its base."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    head = F.substr(html, F.lit(1), F.length(F.substring_index(ascii_lower(html), "<body", 1)))
    e = pages.where(html.rlike("(?i)canonical|http-equiv")).select(F.col(url_col).alias("u"), let(head, lambda h: F.struct(_own_base(h).alias("base"), _links_in(h).alias("links"))).alias("x"))
    base = F.when(F.col("x.base") == "", F.col("u")).otherwise(F.coalesce(resolved(F.col("u"), F.col("x.base")), F.col("u")))
    named = let(base, lambda b: F.transform("x.links", lambda link: let(resolved(b, link), node)))
    return e.select(node(F.col("u")).alias("a"), F.explode(named).alias("b")).where("a is not null and b is not null")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, component) per row of pages; redirects may add edges (source, target) of urls.

    Null urls and urls without :// have an empty host and path, fit no rule, have no aliases and are allowed. Rows may
    repeat; each is judged. An alias known only from a link can carry a rule's block too. Columns other than the three
    named are left alone; of rules of one length the later in the list holds.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")))
    edges = cut(edges.where("a <> b").distinct())
    comp = cut(connected_components(edges))
    url = F.concat(F.lit("http://"), F.col("node"))
    ruled = comp.withColumn("v", first_rule(host_of(url), path_of(url), rules)[1])
    carried = ruled.groupBy("component").agg(F.when(F.bool_or(F.col("v") == "allow"), "allow").when(F.bool_or(F.col("v") == "block"), "block").otherwise("allow").alias("carried"))
    aliases = comp.join(carried, "component").select(F.col("node").alias("__node"), "component", "carried")
    name, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), node(F.col(url_col)).alias("__node"))
    out = rows.withColumns({"rule": name, "__own": verdict}).join(aliases, "__node", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("__own", "carried", F.lit("allow")).alias("verdict"), "component")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_RULE_ROWS = ", ".join(f"('{v}', '{r}')" for v, r in RULES)
#: The test pages carry no canonical links or refreshes, so rules alone decide there.
ORACLE = f"""
with rules(v, r) as (values {_RULE_ROWS}),
u as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select page_id, arg_max(r, length(r)) as rule, arg_max(v, length(r)) as verdict from p, rules
      where (host = split_part(r, '/', 1) or ends_with(host, '.' || split_part(r, '/', 1))) and starts_with(path, substr(r, position('/' in r))) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict, cast(null as varchar) as component from p left join f using (page_id)
"""
