"""URL filters that see through redirects.

Rules block or allow a host, its subdomains and a path prefix; the longest fitting rule decides. A page without a rule
goes with its aliases: pages and targets joined by redirect and canonical-link edges, however many steps away, are one
component. An explicit allow among them takes precedence over a block; without either a page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, table, written
from .components import components

#: (verdict, host, path), as the query of the shared tables states them.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What aliases are compared by: host, path and query, without scheme and fragment. Null without a host."""
    key = F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit("")))
    return F.when(host_of(url) != "", key)


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Of equal ones an allow wins."""
    fitting = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(verdict == "allow").alias("a"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<n:int,a:boolean,rule:string,verdict:string>")


def resolve(base: Column, link: Column) -> Column:
    """A link on the page base as an absolute URL."""
    link = F.trim(link)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.concat(root, path_of(base)), r"(?s)^(.*?://.*/)", 1)
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"^[?#]"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of each page and of its canonical link and its immediate redirect (meta refresh) targets."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    wanted = F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)^<meta\b.*http-equiv\s*=\s*[\"']?refresh\b"))
    href = F.transform(wanted, lambda t: F.when(t.rlike("(?i)^<link"), F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).otherwise(F.regexp_extract(t, r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)", 1)))
    some = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    found = some.select("url", F.explode(href).alias("link")).select("url", resolve(F.col("url"), F.col("link")).alias("to"))
    return found.select(key_of(F.col("url")).alias("a"), key_of(F.col("to")).alias("b")).where("a is not null and b is not null and a != b")


#: Query parameters that say where a visitor came from, and subdomains of the same site.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid|source|campaign)"
SAME_SITE = r"(?:www|m|mobile|amp)"


def usual_redirects(pages: DataFrame) -> DataFrame:
    """(url, to) of the pages that sites usually redirect: from hosts for browsers or telephones to the site itself
    (only where two names remain), and from URLs with tracking parameters to those without. Others give no row."""
    url = F.col("url")
    bare = F.regexp_replace(url, rf"(?s)^([^:/?#]*://){SAME_SITE}\.([^/?#.]+\.[^/?#]+)", "$1$2")
    clean = F.regexp_replace(F.regexp_replace(bare, r"(?s)#.*$", ""), rf"(?<=[?&]){TRACKING}=[^&#]*&?", "")
    to = F.regexp_replace(clean, r"[?&]$", "")
    known = pages.where(url.contains("://")).select("url", to.alias("to"))
    return known.where(key_of(F.col("url")) != key_of(F.col("to"))).distinct()


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``redirects`` adds edges (url, to) known from crawling.

    rules: a bounded list, part of the plan. Null urls and those without :// have empty host and path and no aliases.
    Equal pages are each judged; columns other than page_id, url and html are not read, and a table without html has
    no canonical links.
    """
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    edges = alias_edges(own)
    if redirects is not None:
        more = redirects.select(key_of(F.col("url")).alias("a"), key_of(F.col("to")).alias("b"))
        edges = edges.unionByName(more.where("a is not null and b is not null and a != b"))
    tree = components(edges)
    fits = rule_for(ascii_lower(F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1), rules)
    decided = tree.select("root", fits.alias("r")).groupBy("root").agg(F.bool_or(F.col("r.verdict") == "allow").alias("allowed"), F.bool_or(F.col("r.verdict") == "block").alias("blocked"))
    passed = tree.join(decided, "root").select("node", F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").alias("alias"))
    named = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    named = named.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    judged = named.join(passed, named.key == passed.node, "left")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "alias", F.lit("allow")).alias("verdict"))


def op8_redirect_equivalence(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by the rules, passed along canonical links, immediate redirects and usual redirects.

    Usual redirects join pages of one path and site; the rules tell none of these apart, so that they change no verdict
    of these tables' rules, which is why the SQL does without them. Null urls have no rule and are allowed; repeated
    rows are each judged; other columns are not read.
    """
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, redirects=usual_redirects(pages))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's'), '') AS rest
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tags AS (SELECT host, path, rest, unnest(regexp_extract_all(html, '<(?:link|meta)\b[^>]*>', 0, 'is')) AS tag FROM p),
links AS (
  SELECT host || rest AS a, regexp_extract(tag, CASE WHEN tag ILIKE '<link%' THEN '\bhref\s*=\s*["'']?([^"''\s>]+)' ELSE 'url\s*=\s*["'']?([^"''\s>]+)' END, 1, 'is') AS link
  FROM tags WHERE host <> '' AND (regexp_matches(tag, '^<link\b.*\brel\s*=\s*["'']?canonical\b', 'is') OR regexp_matches(tag, '^<meta\b.*http-equiv\s*=\s*["'']?refresh\b', 'is'))),
edges AS (
  SELECT a, translate(regexp_extract(link, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(link, '^.*?://[^/?#]*([^#]*)', 1, 's') AS b
  FROM links WHERE contains(link, '://')),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
decided AS (
  SELECT a, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM (
    SELECT r.a, x.b, first(rules.verdict ORDER BY length(rules.h || rules.p) DESC) AS verdict
    FROM reach r, (SELECT DISTINCT b, regexp_extract(b, '^([^/?#]*)', 1, 's') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM reach) x, rules
    WHERE r.b = x.b AND (x.host = rules.h OR ends_with(x.host, '.' || rules.h)) AND starts_with(x.path, rules.p) GROUP BY ALL) GROUP BY a),
best AS (
  SELECT page_id, first(h || rules.p ORDER BY length(h || rules.p) DESC) AS rule, first(verdict ORDER BY length(h || rules.p) DESC) AS verdict
  FROM p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, best.rule,
  coalesce(best.verdict, CASE WHEN d.allowed THEN 'allow' WHEN d.blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN best ON best.page_id = p.page_id LEFT JOIN decided d ON d.a = p.host || p.rest AND p.host <> ''
"""
