"""URL filters that see through redirects.

Addresses that differ only in what servers redirect anyway (scheme, www and m hosts,
default port, fragment, tracking parameters, final slash, .html) have one canonical form.
Redirects and canonical links join canonical forms; what they connect is one component.
A block of any of its addresses holds for all of them, but an address that an allow rule
names itself stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .components import components

#: (decision, rule): a host with all below it, or an address from its host on with all below its path.
RULES: list[tuple[str, str]] = [
    ("block", "spam-farm.example.org"),
    ("block", "casino-win.example.net"),
    ("block", "cheap-pills.example.net"),
    ("block", "free-bets.example.net"),
    ("allow", "free-bets.example.net/de"),
    ("allow", "blog.cheap-pills.example.net/es"),
]

_TRACKING = "(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
_LINK = "(?is)<link\\s[^>]*rel\\s*=\\s*[\"']?canonical\\b[^>]*>"
_META = "(?is)<meta\\s[^>]*http-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>"
_HREF = "(?is)href\\s*=\\s*[\"']?([^\"'\\s>]+)"
_TO = "(?is)url\\s*=\\s*['\"]?([^\"'\\s>]+)"
_SCHEME = "^(?i:[a-z][a-z0-9+.-]*:)?//"


def canonical(url: Column) -> Column:
    """host/path?query of an address; null for null and for addresses without a host."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), _SCHEME, "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "(/index)?[.]html?$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "[?](.*)$", 1), _TRACKING, ""), "^&", "")
    name = F.regexp_replace(F.regexp_replace(F.lower(host), ":(80|443)$", ""), "^(www|m)[.]", "")
    return F.when(name != "", F.concat(name, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolved(target: Column, url: Column) -> Column:
    """An address found on a page, made absolute; null for none."""
    origin = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "[^/]*$", "")
    return F.when(target == "", None).when(target.rlike("^(?i:[a-z][a-z0-9+.-]*:)?//"), target).when(target.startswith("/"), F.concat(origin, target)).otherwise(F.concat(folder, target))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) canonical forms that a page's canonical link or refresh joins."""
    link = F.regexp_extract(F.regexp_extract(html_col, _LINK, 0), _HREF, 1)
    meta = F.regexp_extract(F.regexp_extract(html_col, _META, 0), _TO, 1)
    found = pages.where(F.col(html_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.explode(F.array(link, meta)).alias("to")).where("to <> ''")
    return found.select(canonical(F.col("url")).alias("src"), canonical(resolved(F.col("to"), F.col("url"))).alias("dst")).dropna().distinct()


def _keys(form: Column) -> Column:
    """Every rule that could name a canonical form: its host and parent domains, and its path's prefixes."""
    bare = F.regexp_extract(form, "^[^?]*", 0)
    host = F.regexp_extract(bare, "^[^/]*", 0)
    names, parts = F.split(host, "[.]"), F.split(bare, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(hosts, paths, F.array(form)))


def filtered(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, canonical, component, decision, by) of every page.

    ``component`` is the least canonical form it is joined with, its own where nothing
    joins it.  ``decision`` is 'allow' where an allow rule names the address itself, also
    against a block; else 'block' where a block rule names it (by 'rule') or any address
    joined with it (by 'alias'); else 'none'.  ``rules`` has (decision, rule) and may repeat rows;
    ``redirects`` (src, dst) adds edges.  A null url, or one without a host, has null
    canonical and component and the decision 'none'.  Pages that repeat are decided each;
    other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), canonical(F.col(url_col)).alias("canonical"))
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst")).dropna())
    joined = components(edges, "src", "dst")
    nodes = rows.select("canonical").unionByName(joined.select(F.col("node").alias("canonical"))).dropna().distinct()
    clean = rules.select(F.col("decision"), canonical(F.col("rule")).alias("rule")).dropna().distinct()
    named = nodes.select("canonical", F.explode(_keys(F.col("canonical"))).alias("rule")).join(clean, "rule")
    own = named.groupBy("canonical").agg(F.max(F.col("decision") == "allow").alias("allowed"), F.max(F.col("decision") == "block").alias("blocked"))
    of = nodes.join(joined.select(F.col("node").alias("canonical"), "component"), "canonical", "left").join(own, "canonical", "left")
    of = of.select("canonical", F.coalesce("component", "canonical").alias("component"), F.coalesce("allowed", F.lit(False)).alias("allowed"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    bad = of.where("blocked").select("component").distinct().withColumn("alias", F.lit(True))
    of = of.join(bad, "component", "left")
    decided = rows.join(of, "canonical", "left")
    decision = F.when(F.col("allowed"), "allow").when(F.col("blocked") | F.col("alias"), "block").otherwise("none")
    by = F.when(F.col("allowed") | F.col("blocked"), "rule").when(F.col("alias"), "alias")
    return decided.select("page_id", "url", "canonical", "component", decision.alias("decision"), by.alias("by"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every page of the table, by a rule or by an alias of its address.

    Nulls, ties, repeated rows, empty tables and further columns are as in ``filtered``;
    of a page's text only canonical links and refreshes are read, and an empty one has none.
    """
    rules = spark.createDataFrame(RULES, "decision string, rule string")
    return filtered(table(spark, sf_dir, "pages"), rules)


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def form(u: str) -> str:
        bare = f"regexp_replace(regexp_replace(trim({u}), '#.*$', ''), {q(_SCHEME)}, '')"
        host, rest = f"regexp_extract({bare}, '^[^/?]*', 0)", f"regexp_replace({bare}, '^[^/?]*', '')"
        path = f"regexp_replace(regexp_replace(regexp_extract({rest}, '^[^?]*', 0), '(/index)?[.]html?$', ''), '/+$', '')"
        query = f"regexp_replace(regexp_replace(regexp_extract({rest}, '[?](.*)$', 1), {q(_TRACKING)}, '', 'g'), '^&', '')"
        name = f"regexp_replace(regexp_replace(lower({host}), ':(80|443)$', ''), '^(www|m)[.]', '')"
        return f"CASE WHEN {name} <> '' THEN {name} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"

    rules = ", ".join(f"({q(d)}, {q(r)})" for d, r in RULES)
    return f"""
WITH RECURSIVE rules AS (SELECT DISTINCT decision, {form("r")} AS rule FROM (VALUES {rules}) AS v(decision, r)),
rows AS (SELECT page_id, url, {form("url")} AS canonical FROM pages),
found AS (
  SELECT url, regexp_extract(regexp_extract(html, {q(_LINK)}, 0), {q(_HREF)}, 1) AS target FROM pages WHERE html IS NOT NULL AND url IS NOT NULL
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, {q(_META)}, 0), {q(_TO)}, 1) FROM pages WHERE html IS NOT NULL AND url IS NOT NULL
),
absolute AS (
  SELECT url, CASE WHEN regexp_matches(target, '^(?i:[a-z][a-z0-9+.-]*:)?//') THEN target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0) || target
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || target END AS target
  FROM found WHERE target <> ''
),
edges AS (SELECT DISTINCT {form("url")} AS a, {form("target")} AS b FROM absolute),
both_ways AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
joined AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
nodes AS (SELECT canonical FROM rows WHERE canonical IS NOT NULL UNION SELECT node FROM joined),
named AS (
  SELECT canonical, bool_or(decision = 'allow') AS allowed, bool_or(decision = 'block') AS blocked
  FROM nodes JOIN rules ON regexp_extract(canonical, '^[^/?]*', 0) = rule
    OR ends_with(regexp_extract(canonical, '^[^/?]*', 0), '.' || rule)
    OR canonical = rule OR regexp_extract(canonical, '^[^?]*', 0) = rule OR starts_with(regexp_extract(canonical, '^[^?]*', 0), rule || '/')
  GROUP BY canonical
),
state AS (
  SELECT canonical, coalesce(component, canonical) AS component, coalesce(allowed, false) AS allowed, coalesce(blocked, false) AS blocked
  FROM nodes LEFT JOIN joined ON canonical = node LEFT JOIN named USING (canonical)
),
bad AS (SELECT DISTINCT component FROM state WHERE blocked)
SELECT page_id, url, rows.canonical, state.component,
  CASE WHEN allowed THEN 'allow' WHEN blocked OR bad.component IS NOT NULL THEN 'block' ELSE 'none' END AS decision,
  CASE WHEN allowed OR blocked THEN 'rule' WHEN bad.component IS NOT NULL THEN 'alias' END AS "by"
FROM rows LEFT JOIN state ON rows.canonical = state.canonical LEFT JOIN bad ON state.component = bad.component
"""


OP10_SQL = _sql()
