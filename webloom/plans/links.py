"""Queries on captured pages: addresses, links, the per-site link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import urls as U
from webloom.operators import graph as G
from webloom.operators import links as L
from webloom.operators import ranks as R
from webloom.plans.registry import query, shaped, table
from webloom.sources.pages import spread

TRACKING_RX = "^(" + "|".join(seeds.TRACKING_PARAMS) + ")(=|$)"


def duck_norm(u: str) -> str:
    """SQL normal form of an absolute page address without odd characters."""
    host = f"lower(regexp_extract({u}, '^(https?://[^/?#]*)', 1))"
    path = f"rtrim(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1), '/')"
    kept = (
        f"list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), "
        f"lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING_RX}'))"
    )
    return (
        f"({host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"
    )


DUCK_LINKS = """links AS (
  SELECT page_id, url AS page_url, unnest(generate_series(0, len(hs) - 1)) AS pos, unnest(hs) AS href, unnest(ts) AS text
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ts FROM pages)
  WHERE len(hs) > 0)"""

DUCK_EDGES = (
    DUCK_LINKS
    + f""", edges AS (
  SELECT source, target, arg_min(text, page_id * 100000 + pos) AS anchor, min(page_id * 100000 + pos) AS seq
  FROM (SELECT {duck_norm('page_url')} AS source, page_id, pos, text,
               regexp_extract(page_url, '^(https?://[^/?#]*)', 1) || href AS target FROM links)
  GROUP BY source, target), visited AS (SELECT DISTINCT {duck_norm('url')} AS url FROM pages)"""
)


def page_edges(spark, sf) -> DataFrame:
    return L.build_edges(L.extract_links(spread(table(spark, sf, "pages"))))


# ------------------------------------------------------------------ addresses
@query(
    "normalised_page_urls",
    f"""SELECT page_id, {duck_norm('url')} AS url FROM pages""",
)
def normalised_page_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalise("url").alias("url"))


# one order, one address of each awkward kind; the check SQL states the answer outright
ADDRESSES = """
SELECT o_orderkey AS id, 'https://www.Shop' || CAST(o_custkey % 7 AS STRING) || '.example.co.uk/a/b/c?x=1' AS base,
  CASE o_orderkey % 16
    WHEN 0 THEN '../up/' || CAST(o_custkey AS STRING) || '/'
    WHEN 1 THEN './here;v=1'
    WHEN 2 THEN '/root//' || CAST(o_custkey AS STRING) || '?b=2&UTM_Source=mail&a'
    WHEN 3 THEN '//Cdn.example.net:443/lib.js'
    WHEN 4 THEN 'HTTP://Plain.example.org:80/' || o_orderpriority || '#top'
    WHEN 5 THEN 'mailto:a@example.com'
    WHEN 6 THEN '?page=' || CAST(o_custkey AS STRING) || '&gclid=9'
    WHEN 7 THEN '#section'
    WHEN 8 THEN '../../../../x/../y/.'
    WHEN 9 THEN 'JavaScript:void(0)'
    WHEN 10 THEN '/q?s=a b&t=%7E*&u=x%2Fy'
    WHEN 11 THEN ' /pdf/file.PDF '
    WHEN 12 THEN ''
    WHEN 13 THEN 'ftp://files.example.com/x'
    WHEN 14 THEN '/account/logout'
    ELSE 'https://www.facebook.com/share/' END AS href
FROM {orders}"""

ADDRESS_ANSWERS = """
WITH a AS (SELECT *, id % 16 AS k, split_part(base, '/', 3) AS host FROM (""" + ADDRESSES + """)),
n AS (SELECT id, k, lower(host) AS host, CASE k
    WHEN 0 THEN 'https://' || lower(host) || '/a/up/' || split_part(href, '/', 3)
    WHEN 1 THEN 'https://' || lower(host) || '/a/b/here'
    WHEN 2 THEN 'https://' || lower(host) || '/root//' || regexp_extract(href, '//([0-9]+)', 1) || '?b=2&a='
    WHEN 3 THEN 'https://cdn.example.net/lib.js'
    WHEN 4 THEN 'http://plain.example.org/' || regexp_extract(href, '80/([^#]*)', 1)
    WHEN 6 THEN 'https://' || lower(host) || '/a/b/c?' || regexp_extract(href, '(page=[0-9]+)', 1)
    WHEN 7 THEN 'https://' || lower(host) || '/a/b/c?x=1'
    WHEN 8 THEN 'https://' || lower(host) || '/y'
    WHEN 10 THEN 'https://' || lower(host) || '/q?s=a+b&t=~%2A&u=x%2Fy'
    WHEN 11 THEN 'https://' || lower(host) || '/pdf/file.PDF'
    WHEN 14 THEN 'https://' || lower(host) || '/account/logout'
    WHEN 15 THEN 'https://www.facebook.com/share' END AS url FROM a)
"""


@query("normalise_references", ADDRESS_ANSWERS + "SELECT id, url FROM n")
def normalise_references(spark, sf):
    return shaped(spark, sf, ADDRESSES).select("id", U.normalise("href", F.col("base")).alias("url"))


@query(
    "resolve_references",
    "SELECT id, CASE WHEN id % 16 IN (5, 9, 13, 15) THEN href WHEN id % 16 = 12 THEN base WHEN id % 16 = 3 THEN 'https:' || href"
    " WHEN id % 16 = 4 THEN 'http' || replace(substr(href, 5), '#top', '') ELSE 'https://' || split_part(base, '/', 3) || CASE id % 16"
    " WHEN 0 THEN '/a/' || substr(href, 4) WHEN 1 THEN '/a/b/here' WHEN 6 THEN '/a/b/c' || href WHEN 7 THEN '/a/b/c?x=1' WHEN 8 THEN '/y/'"
    " WHEN 11 THEN trim(href) ELSE href END END AS url FROM ("
    + ADDRESSES
    + ")",
)
def resolve_references(spark, sf):
    kinds = shaped(spark, sf, ADDRESSES)
    return kinds.select("id", U.resolve("base", "href").alias("url"))


@query(
    "url_facts",
    ADDRESS_ANSWERS
    + """SELECT id, url,
  CASE k WHEN 2 THEN regexp_extract(url, 'root//(.*)$', 1) WHEN 3 THEN 'example.net' WHEN 4 THEN 'example.org' WHEN 15 THEN 'facebook.com' ELSE 'example.co.uk' END AS domain,
  CASE k WHEN 3 THEN 'cdn.example.net' WHEN 4 THEN 'plain.example.org' WHEN 15 THEN 'facebook.com' ELSE substr(host, 5) END AS host_key,
  k NOT IN (3, 4, 15) AS in_scope, k IN (3, 11) AS asset, k = 11 AS document, k = 15 AS utility,
  CASE k WHEN 3 THEN 'external' WHEN 4 THEN 'external' WHEN 15 THEN 'external' WHEN 11 THEN 'document'
         WHEN 14 THEN 'unsafe/destructive URL' END AS gate,
  regexp_extract(url, '^https?://[^/]*([^?]*)', 1) AS path, regexp_extract(url, '^(https?://[^/]*)', 1) AS origin,
  CASE WHEN length(url) <= 30 THEN url ELSE left(url, 15) || '…' || right(url, 14) END AS short
FROM n WHERE url IS NOT NULL""",
)
def url_facts(spark, sf):
    # a filter on the address would work it out twice, a generated row is worked out once
    found = F.array_compact(F.array(U.normalise("href", F.col("base"))))
    a = shaped(spark, sf, ADDRESSES).select("id", "base", F.explode(found).alias("url"))
    a = a.withColumn("home", U.normalise("base"))
    base = F.col("home")
    return a.select(
        "id",
        "url",
        U.domain_of("url").alias("domain"),
        U.host_key(U.netloc_of("url")).alias("host_key"),
        U.same_scope("url", base).alias("in_scope"),
        U.is_asset("url").alias("asset"),
        U.is_document("url").alias("document"),
        U.is_utility(U.domain_of("url")).alias("utility"),
        U.visit_gate("url", base).alias("gate"),
        U.path_of("url").alias("path"),
        U.origin("url").alias("origin"),
        U.shorten("url", 30).alias("short"),
    )


@query(
    "text_slugs",
    """SELECT doc_id, CASE WHEN s = '' THEN 'shot' ELSE s END AS slug FROM (
  SELECT doc_id, left(trim(regexp_replace(lower(CASE WHEN text = '' THEN 'shot' ELSE text END), '[^a-z0-9]+', '-', 'g'), '-'), 40) AS s FROM documents)""",
)
def text_slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", U.slug("text").alias("slug"))


# ------------------------------------------------------------------ elements and links
@query(
    "element_counts",
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<(/?[a-z][a-z0-9]*)', 1)) AS tag
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs'), '<!--.*?-->', ' ', 'gs') AS html FROM pages))
SELECT page_id, ltrim(tag, '/') AS tag, tag LIKE '/%' AS is_close, count(*) AS n FROM t GROUP BY ALL""",
)
def element_counts(spark, sf):
    e = L.elements(spread(table(spark, sf, "pages")))
    return e.groupBy("page_id", "tag", "is_close").agg(F.count("*").alias("n"))


@query("page_links", "WITH " + DUCK_LINKS + " SELECT page_id, pos, href, left(trim(text), 120) AS text, '' AS rel FROM links")
def page_links(spark, sf):
    return L.extract_links(spread(table(spark, sf, "pages"))).select("page_id", "pos", "href", "text", "rel")


@query(
    "link_edges",
    "WITH " + DUCK_EDGES + " SELECT source, target, left(trim(anchor), 120) AS anchor, true AS internal, false AS nofollow FROM edges",
)
def link_edges(spark, sf):
    return page_edges(spark, sf).select("source", "target", "anchor", "internal", "nofollow")


@query("inbound_counts", "WITH " + DUCK_EDGES + " SELECT target AS url, count(*) AS inbound_internal FROM edges GROUP BY 1")
def inbound_counts(spark, sf):
    return L.inbound_counts(page_edges(spark, sf))


@query("orphan_pages", "WITH " + DUCK_EDGES + " SELECT url FROM visited WHERE url NOT IN (SELECT target FROM edges)")
def orphan_pages(spark, sf):
    pages = table(spark, sf, "pages")
    return L.orphan_pages(L.visited_pages(pages), page_edges(spark, sf))


@query(
    "top_anchors",
    "WITH " + DUCK_EDGES + """ SELECT trim(lower(anchor)) AS text, count(*) AS count FROM edges WHERE trim(anchor) <> ''
GROUP BY 1 ORDER BY count DESC, text LIMIT 20""",
)
def top_anchors(spark, sf):
    return L.top_anchors(page_edges(spark, sf))


@query(
    "graph_stats",
    "WITH " + DUCK_EDGES + """ SELECT (SELECT count(*) FROM visited) AS pages, count(*) AS edges, count(*) AS internal_edges,
0::BIGINT AS external_edges, 0::BIGINT AS external_domains, 0::BIGINT AS nofollow_edges FROM edges""",
)
def graph_stats(spark, sf):
    return L.graph_stats(L.visited_pages(table(spark, sf, "pages")), page_edges(spark, sf))


# ------------------------------------------------------------------ a sparse page graph from orders
PART_EDGES = """
SELECT DISTINCT 'https://shop.example.com/p/' || CAST(a AS STRING) AS source, 'https://shop.example.com/p/' || CAST(b AS STRING) AS target
FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM {lineitem})
WHERE b IS NOT NULL AND a <> b"""
PART_PAGES = "SELECT 'https://shop.example.com/p/' || CAST(p_partkey AS STRING) AS url FROM {part}"

DUCK_RANKS = """e AS (SELECT source AS src, target AS dst FROM pe),
deg AS (SELECT src, count(*) AS d FROM e GROUP BY src), nn AS (SELECT count(*) AS n FROM pp),
f AS (SELECT e.src, e.dst, 1.0::DOUBLE / d AS share FROM e JOIN deg USING (src)
      UNION ALL SELECT p.url, q.url, 1.0::DOUBLE / n FROM pp p, pp q, nn WHERE p.url NOT IN (SELECT src FROM deg)
      UNION ALL SELECT url, url, 0.0::DOUBLE FROM pp),
r(i, node, rank) AS (SELECT 0, url, 1.0::DOUBLE / n FROM pp, nn
      UNION ALL SELECT r.i + 1, f.dst, 0.15 / max(nn.n) + 0.85 * sum(r.rank * f.share) FROM r JOIN f ON f.src = r.node, nn
      WHERE r.i < 40 GROUP BY r.i, f.dst),
ranks AS (SELECT node AS url, round_even(rank / max(rank) OVER () * 100, 1) AS pagerank FROM r WHERE i = 40)"""


def part_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    edges = shaped(spark, sf, PART_EDGES).select("*", F.lit(True).alias("internal"), F.lit(False).alias("nofollow"))
    return shaped(spark, sf, PART_PAGES), edges


@query(
    "internal_pagerank",
    "WITH RECURSIVE pe AS (" + PART_EDGES + "), pp AS (" + PART_PAGES + "), " + DUCK_RANKS + " SELECT url, pagerank FROM ranks",
)
def internal_pagerank(spark, sf):
    return G.internal_pagerank(*part_graph(spark, sf))


# every supplier's parts are a site of their own, and all parts that no line names a site that holds a large share
SITE_EDGES = """
SELECT DISTINCT 'shop' || CAST(s AS STRING) AS site, 'https://shop' || CAST(s AS STRING) || '.com/p/' || CAST(a AS STRING) AS source,
  'https://shop' || CAST(s AS STRING) || '.com/p/' || CAST(b AS STRING) AS target
FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS s, l_partkey AS a,
  lead(l_partkey) OVER (PARTITION BY CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END ORDER BY l_orderkey, l_linenumber, l_partkey) AS b,
  l_orderkey FROM {lineitem})
WHERE b IS NOT NULL AND a <> b AND l_orderkey % 5 < 2"""
SITE_PAGES = """
SELECT DISTINCT 'shop' || CAST(s AS STRING) AS site, 'https://shop' || CAST(s AS STRING) || '.com/p/' || CAST(l_partkey AS STRING) AS url
FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS s, l_partkey FROM {lineitem})"""

DUCK_SITE_RANKS = """e AS (SELECT site, source AS src, target AS dst FROM se),
deg AS (SELECT src, count(*) AS d FROM e GROUP BY src), nn AS (SELECT site, count(*) AS n FROM sp GROUP BY site),
nodes AS (SELECT sp.site, url, n, d FROM sp JOIN nn USING (site) LEFT JOIN deg ON src = url),
f AS (SELECT e.src, e.dst, 1.0::DOUBLE / d AS share FROM e JOIN deg USING (src)
      UNION ALL SELECT 'lost' || site, url, 1.0::DOUBLE / n FROM nodes UNION ALL SELECT url, url, 0.0::DOUBLE FROM nodes),
r(i, node, rank) AS (SELECT 0, url, 1.0::DOUBLE / n FROM nodes
      UNION ALL SELECT q.i + 1, f.dst, 0.15 / max(nodes.n) + 0.85 * sum(q.rank * f.share) FROM (
        SELECT i, node, rank FROM r UNION ALL SELECT i, 'lost' || site, sum(CASE WHEN d IS NULL THEN rank ELSE 0 END) FROM r JOIN nodes ON url = node GROUP BY i, site) q
      JOIN f ON f.src = q.node JOIN nodes ON nodes.url = f.dst WHERE q.i < 40 GROUP BY q.i, f.dst),
site_ranks AS (SELECT site, node AS url, rank / max(rank) OVER (PARTITION BY site) * 100 AS rank FROM r JOIN nodes ON url = node WHERE i = 40)"""


@query(
    "site_pagerank",
    "WITH RECURSIVE se AS (" + SITE_EDGES + "), sp AS (" + SITE_PAGES + "), " + DUCK_SITE_RANKS + " SELECT site, url, round_even(rank, 1) AS pagerank FROM site_ranks",
)
def site_pagerank(spark, sf):
    edges = shaped(spark, sf, SITE_EDGES).select("*", F.lit(True).alias("internal"), F.lit(False).alias("nofollow"))
    return R.site_pagerank(shaped(spark, sf, SITE_PAGES), edges)


@query(
    "top_pages",
    "WITH RECURSIVE pe AS (" + PART_EDGES + "), pp AS (" + PART_PAGES + "), " + DUCK_RANKS
    + """, ib AS (SELECT target AS url, count(*) AS n FROM pe GROUP BY 1)
SELECT url, substr(url, 25) AS path, pagerank, coalesce(n, 0) AS inbound_internal FROM ranks LEFT JOIN ib USING (url)
ORDER BY pagerank DESC, inbound_internal DESC, url LIMIT 25""",
)
def top_pages(spark, sf):
    pages, edges = part_graph(spark, sf)
    return L.top_pages(pages, G.internal_pagerank(pages, edges), edges)


@query(
    "crawl_reach",
    "WITH RECURSIVE pe AS (" + PART_EDGES + """), w(url, depth) AS (SELECT 'https://shop.example.com/p/0', 0
UNION SELECT pe.target, w.depth + 1 FROM w JOIN pe ON pe.source = w.url WHERE w.depth < 3)
SELECT url, min(depth) AS depth FROM w GROUP BY url""",
)
def crawl_reach(spark, sf):
    _, edges = part_graph(spark, sf)
    start = spark.createDataFrame([("https://shop.example.com/p/0", 0)], "url string, seq long")
    seen = G.reach(edges.withColumn("seq", F.col("target")), start, max_depth=3, max_pages=10**12)
    return seen.select("url", "depth")


def duck_walk(depths: int, budget: int) -> str:
    """Check SQL of a walk from part 0: one common table per depth, numbered on from the depth before."""
    steps = ["l0 AS (SELECT 'https://shop.example.com/p/0' AS url, 0 AS depth, 1 AS place)"]
    for d in range(1, depths + 1):
        seen = " UNION ALL ".join(f"SELECT url FROM l{i}" for i in range(d))
        steps.append(
            f"l{d} AS (SELECT * FROM (SELECT url, {d} AS depth, (SELECT max(place) FROM l{d - 1}) + row_number() OVER (ORDER BY p, url) AS place\n"
            f"  FROM (SELECT target AS url, min(place) AS p FROM l{d - 1} JOIN pe ON source = url WHERE target NOT IN ({seen}) GROUP BY 1)) WHERE place <= {budget})"
        )
    return ", ".join(steps) + "\n" + " UNION ALL ".join(f"SELECT url, depth, place FROM l{d}" for d in range(depths + 1))


@query("crawl_reach_budget", "WITH pe AS (" + PART_EDGES + "), " + duck_walk(3, 200))
def crawl_reach_budget(spark, sf):
    """The same walk with a page budget; checked against a queue in the tests, too."""
    _, edges = part_graph(spark, sf)
    start = spark.createDataFrame([("https://shop.example.com/p/0", 0)], "url string, seq long")
    return G.reach(edges.withColumn("seq", F.col("target")), start, max_depth=3, max_pages=200).select("url", "depth", "place")
