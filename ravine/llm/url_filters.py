"""URL filters: rules for hosts and paths, whose blocks reach every alias of a blocked address.

Addresses are equivalent if redirects or canonical links join them, in any number of steps. The
links are a page's `<link rel="canonical">`, its `<meta http-equiv="refresh">`, a table of
redirects where a crawl has one, and the redirects that servers make for addresses which differ
only in scheme, default port, fragment, closing slashes and tracking parameters. Connected
components (components.py) give the classes; no class is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravine.llm.common import discard, packed, stored, unpacked
from ravine.llm.components import components

#: (action, host, path): a rule fits its host and all subdomains, where the path starts with its own.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
_TRACKING = "(?i)^(?:utm_[a-z]+|gclid|fbclid|ref)="
_ATTRIBUTE = "(?is)[\\s\"']%s\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z in lower case; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, a hash or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def alias_of(url: Column) -> Column:
    """The form that equivalent spellings of an address share; null without a host.

    Scheme, default ports, fragment, closing slashes and tracking parameters go; the order of the
    other parameters stays.
    """
    host = F.regexp_replace(host_of(url), ":(?:80|443)$", "")
    kept = F.array_join(F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "&"), lambda q: (q != "") & ~F.regexp_like(q, F.lit(_TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, _ATTRIBUTE % name, i) for i in (1, 2, 3)))


def _absolute(target: Column, url: Column) -> Column:
    """target as an address, read from the page at url."""
    scheme = F.regexp_extract(url, "(?s)^(.*?)://", 1)
    folder = F.regexp_replace(F.concat(path_of(url), F.lit("")), "[^/]*$", "")
    here = F.concat(scheme, F.lit("://"), host_of(url))
    return (
        F.when(F.regexp_like(target, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(here, target))
        .when(F.startswith(target, F.lit("?")), F.concat(here, path_of(url), target))
        .otherwise(F.concat(here, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses of the canonical links and refreshes in pages (url, html); null pages have none."""
    html, url = F.col("html"), F.col("url")
    tags = F.regexp_extract_all(html, F.lit("(?is)<(?:link|meta)\\s[^>]*>"), 0)

    def canonical(t: Column) -> Column:
        return F.regexp_like(t, F.lit("(?is)^<link\\s")) & F.array_contains(F.split(F.lower(_attribute(t, "rel")), "\\s+"), "canonical")

    def refresh(t: Column) -> Column:
        return F.regexp_like(t, F.lit("(?is)^<meta\\s")) & (F.lower(_attribute(t, "http-equiv")) == "refresh")

    target = lambda t: F.when(canonical(t), _attribute(t, "href")).when(
        refresh(t), F.regexp_extract(_attribute(t, "content"), "(?is)^[^;,]*[;,]\\s*url\\s*=\\s*['\"]?([^'\"]*)", 1)
    )
    targets = F.filter(F.transform(tags, lambda t: F.trim(target(t))), lambda x: x.isNotNull() & (x != "") & ~F.startswith(x, F.lit("#")))
    found = pages.where(F.contains(url, F.lit("://"))).select("url", F.explode(targets).alias("_target"))
    return found.select(F.col("url").alias("src"), _absolute(F.col("_target"), url).alias("dst"))


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """urls (host, path: each pair once) with `rule` and `decision` of the longest rule that fits; null where none does.

    A pair meets rules by equality: its host's ends of as many labels as rules have, and its path's
    beginnings of the lengths that rules have. Of equally long rules an allow wins. The rules are
    a setting that the driver holds, so they are broadcast.
    """
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "decision": F.lit(None).cast("string")})
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, a) for a, h, p in rules], "_h string, _p string, _action string")
    order = F.struct(F.length(F.concat("_h", "_p")).alias("n"), (F.col("_action") == "allow").alias("allow"), F.concat("_h", "_p").alias("rule"), F.col("_action").alias("action"))
    labels = max(h.count(".") + 1 for _, h, _ in rules)
    ends = F.array_distinct(F.array(*(F.substring_index("host", ".", -i) for i in range(1, labels + 1))))
    starts = F.array_distinct(F.array(*(F.substring("path", 1, n) for n in sorted({len(p) for _, _, p in rules}))))
    tried = urls.withColumn("_end", F.explode(ends)).withColumn("_start", F.explode(starts))
    met = tried.join(F.broadcast(table), (F.col("_end") == F.col("_h")) & (F.col("_start") == F.col("_p")), "left")
    best = met.groupBy("host", "path").agg(F.max(F.when(F.col("_h").isNotNull(), order)).alias("_best"))
    return best.select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best.action").alias("decision"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(url, host, path, rule, verdict) of each different url of pages (url, html) that is not null.

    verdict is the rule's where one fits. Elsewhere the class of the address decides: an explicit
    allow of any of its addresses comes first, then a block of any, and without either it is
    allowed. redirects (src, dst) are further links. A chain of links may pass through addresses
    that have no page of their own; a rule decides on them as well.
    """
    addresses = pages.where("url is not null").select("url").distinct()
    links = page_links(pages)
    links = links if redirects is None else links.union(redirects.select("src", "dst"))
    ends = stored(links.select("src", "dst").where("src is not null and dst is not null").distinct(), "url-links")
    everything = addresses.select("url").union(ends.select("src")).union(ends.select("dst")).distinct()
    known = everything.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_of(F.col("url")).alias("alias"))
    known = stored(known, "addresses")
    rule = ruled(known.select("host", "path").distinct(), rules)
    roots = components(ends.select(alias_of(F.col("src")).alias("a"), alias_of(F.col("dst")).alias("b")), "a", "b")
    classed = known.join(rule, ["host", "path"]).join(roots, F.col("alias") == F.col("node"), "left")
    classed = stored(classed.select("url", "host", "path", "rule", "decision", F.coalesce("root", "alias").alias("class")), "url-classes")
    said = classed.where("decision is not null and class is not null").groupBy("class").agg(F.max(F.col("decision") == "allow").alias("_allow"))
    verdict = F.coalesce("decision", F.when(F.col("_allow") == F.lit(False), "block").otherwise("allow"))
    judged = classed.join(said, "class", "left").join(addresses.select("url"), "url", "left_semi")
    out = stored(judged.select("url", "host", "path", "rule", verdict.alias("verdict")), "url-verdicts")
    discard(ends, known, classed)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Every row of pages (url, html, others) without html, with host, path, rule and verdict.

    Rows may repeat and keep their number. A null url, or one without ://, has an empty host and
    path, no rule and the verdict allow. Columns of the same names are replaced. An empty table
    gives an empty one.
    """
    found = url_verdicts(pages.select("url", "html"), rules, redirects).withColumnRenamed("url", "_url")
    own = ("html", "host", "path", "rule", "verdict")
    rows = pages.select(packed(pages, *own).alias("_row")).join(found, F.col("_row.url") == F.col("_url"), "left")
    empty = F.lit("")
    return rows.select(*unpacked(rows, "_row"), F.coalesce("host", empty).alias("host"), F.coalesce("path", empty).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """The rows of pages, with all their columns, whose verdict is allow; a null url is allowed."""
    bad = url_verdicts(pages.select("url", "html"), rules, redirects).where("verdict = 'block'").select("url")
    return pages.join(bad, "url", "left_anti").select(*pages.columns)


def _sql_rule(host: str, path: str, field: str) -> str:
    fits = " ".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{a if field == 'decision' else h + p}'"
        for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {fits} END"


def _sql_alias(url: str) -> str:
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
    kept = f"array_to_string(list_filter(string_split(regexp_extract({url}, '{parts}', 3), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}')), '&')"
    host = f"regexp_replace(translate(regexp_extract({url}, '{parts}', 1), '{ascii_uppercase}', '{ascii_lowercase}'), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({url}, '{parts}', 2), '/+$', '')"
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"


#: The same in DuckDB. The given pages hold neither canonical links nor refreshes (tests/llm has pages that do), so classes are aliases.
ORACLE_SQL = f"""
WITH u AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, {_sql_alias('url')} AS alias FROM pages),
r AS (SELECT *, {_sql_rule('host', 'path', 'rule')} AS rule, {_sql_rule('host', 'path', 'decision')} AS decision FROM u)
SELECT page_id, host, path, rule,
  coalesce(decision, CASE WHEN alias IS NOT NULL AND bool_or(decision = 'block') OVER (PARTITION BY alias)
    AND NOT bool_or(decision = 'allow') OVER (PARTITION BY alias) THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""
