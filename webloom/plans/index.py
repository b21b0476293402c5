"""Queries on the multi-site index. The orders make the web: an order is a page of
its customer's nation, a part is a page of its supplier's nation, a line is a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import authority as A
from webloom.operators import index as I
from webloom.operators.ranks import Workspace
from webloom.plans.registry import query, shaped
from webloom.session import cut_lineage

LINKS = """
SELECT 'https://nation' || CAST(c_nationkey AS STRING) || '.com/o/' || CAST(o_orderkey AS STRING) AS source,
  'https://nation' || CAST(s_nationkey AS STRING) || '.com/p/' || CAST(p_partkey AS STRING) AS target,
  p_name AS anchor, c_nationkey = s_nationkey AS internal, l_returnflag = 'R' AS nofollow,
  CAST(l_linenumber * 100000000000 + l_suppkey * 100000000 + l_quantity * 1000000 + l_discount * 100 * 1000 + l_tax * 100 AS BIGINT) AS seq,
  CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 1 ELSE 2 END AS batch
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey"""

# crawl results: one event of a user is one result for that nation's domain
RESULTS = """
SELECT 'nation' || CAST(user_id % 29 AS STRING) || '.com' AS domain, event_type = 'signup' AS off_topic,
  CASE WHEN event_type = 'purchase' THEN 5 ELSE 0 END AS pages,
  CASE WHEN event_type = 'error' THEN 'net::ERR_' || props ELSE '' END AS error,
  event_id AS seq, 3000 AS now
FROM {events} WHERE event_type IN ('signup', 'purchase', 'error')
  AND (user_id % 29 NOT IN (3, 7, 11, 12, 15, 20) OR (event_type = 'error' AND user_id > 140))"""

IDX = "raw AS (" + LINKS + """), idx AS (
  SELECT source AS source_url, target AS target_url, split_part(source, '/', 3) AS source_domain, split_part(target, '/', 3) AS target_domain,
    arg_max(anchor, batch * 1000000000000000 + seq) AS anchor, CAST(arg_min(internal, batch * 1000000000000000 + seq) AS INT) AS internal,
    CAST(arg_max(nofollow, batch * 1000000000000000 + seq) AS INT) AS nofollow, min(batch) * 1000 AS first_seen, max(batch) * 1000 AS last_seen
  FROM raw GROUP BY 1, 2, 3, 4),
dom AS (SELECT domain, min(f) AS first_seen, max(l) AS last_seen, max(c) AS crawled, CAST(sum(a) AS INT) AS attempts,
    arg_max(e, s) FILTER (WHERE s IS NOT NULL) AS last_error, max(o) AS offtopic FROM (
  SELECT source_domain AS domain, first_seen AS f, last_seen AS l, 0 AS c, 0 AS a, NULL AS e, NULL AS s, 0 AS o FROM idx
  UNION ALL SELECT target_domain, first_seen, last_seen, 0, 0, NULL, NULL, 0 FROM idx
  UNION ALL SELECT domain, now, now, CAST(NOT off_topic AND pages > 0 AS INT), CAST(NOT off_topic AND pages = 0 AS INT),
    error, CASE WHEN NOT off_topic AND pages = 0 THEN seq END, CAST(off_topic AS INT) FROM (""" + RESULTS + """)) GROUP BY domain),
de AS (SELECT source_domain AS s, target_domain AS t, count(DISTINCT source_url) AS w FROM idx
  WHERE internal = 0 AND source_domain <> target_domain AND nofollow = 0 GROUP BY 1, 2),
dc AS (SELECT target_domain AS domain, count(DISTINCT source_domain) AS referring_domains, count(*) AS backlinks FROM idx
  WHERE source_domain <> target_domain GROUP BY 1)"""

RANK = """, nodes AS (SELECT s AS node FROM de UNION SELECT t FROM de), nn AS (SELECT count(*) AS n FROM nodes),
tot AS (SELECT s, sum(w) AS tw FROM de GROUP BY s),
f AS (SELECT s AS src, t AS dst, w::DOUBLE / tw AS share FROM de JOIN tot USING (s)
  UNION ALL SELECT a.node, b.node, 1.0::DOUBLE / n FROM nodes a, nodes b, nn WHERE a.node NOT IN (SELECT s FROM tot)
  UNION ALL SELECT node, node, 0.0::DOUBLE FROM nodes),
r(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE / n FROM nodes, nn
  UNION ALL SELECT r.i + 1, f.dst, 0.15 / max(nn.n) + 0.85 * sum(r.rank * f.share) FROM r JOIN f ON f.src = r.node, nn
  WHERE r.i < 60 GROUP BY r.i, f.dst),
pr AS (SELECT node AS domain, rank FROM r WHERE i = 60)"""

BOARD = RANK + """, keys AS (SELECT domain FROM pr UNION SELECT domain FROM dc UNION SELECT domain FROM dom),
rd AS (SELECT t AS domain, count(*) AS k FROM de GROUP BY 1),
sig AS (SELECT keys.domain, rank, log10(rank) AS lr, log10(1 + coalesce(k, 0)) AS lk FROM keys LEFT JOIN pr USING (domain) LEFT JOIN rd USING (domain)),
bl AS (SELECT domain, rank, 0.55 * coalesce((lr - min(lr) OVER ()) / (max(lr) OVER () - min(lr) OVER ()), 0)
  + 0.45 * (lk - min(lk) OVER ()) / (max(lk) OVER () - min(lk) OVER ()) AS b FROM sig),
board AS (SELECT domain, CAST(greatest(1, round_even(100 * b / max(b) OVER (), 0)) AS INT) AS authority, coalesce(rank, 0) AS pagerank,
  coalesce(referring_domains, 0) AS referring_domains, coalesce(backlinks, 0) AS backlinks, coalesce(crawled, 0) = 1 AS crawled,
  coalesce(offtopic, 0) = 1 AS utility, coalesce(referring_domains, 0) < 2 AS thin
  FROM bl LEFT JOIN dc USING (domain) LEFT JOIN dom USING (domain))"""


#: The same rows with the orders joined to their customers first: the lines are shuffled once less.
LINKED = LINKS.replace("{orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey",
  "({orders} JOIN {customer} ON o_custkey = c_custkey) ON l_orderkey = o_orderkey")


def links(spark, sf, batch: int | None = None) -> DataFrame:
    rows = shaped(spark, sf, LINKED)
    return rows if batch is None else rows.where(F.col("batch") == batch)


def empty(spark, columns: str) -> DataFrame:
    return spark.createDataFrame([], columns)


EDGE_SCHEMA = (
    "source_url string, target_url string, source_domain string, target_domain string, anchor string, "
    "internal int, nofollow int, first_seen long, last_seen long"
)
PAGE_SCHEMA = "url string, domain string, first_seen long, last_seen long"


def written_links(spark, sf) -> dict[int, DataFrame]:
    """The links of each batch as written tables, for queries that read them several times."""
    return {batch: cut_lineage(links(spark, sf, batch), "links") for batch in (1, 2)}


def merged(spark, sf, rows: dict[int, DataFrame] | None = None) -> DataFrame:
    """The index after both batches, in one lazy plan."""
    rows = rows or {batch: links(spark, sf, batch) for batch in (1, 2)}
    first = I.merge_edges(empty(spark, EDGE_SCHEMA), rows[1], 1000)
    return I.merge_edges(first, rows[2], 2000)


def edges(spark, sf, rows: dict[int, DataFrame] | None = None) -> DataFrame:
    return merged(spark, sf, rows).select(*I.EDGE_COLUMNS)


def domains(spark, sf, rows: dict[int, DataFrame] | None = None) -> DataFrame:
    rows = rows or {batch: links(spark, sf, batch) for batch in (1, 2)}
    known = empty(spark, I.DOMAIN_SCHEMA)
    for batch in (1, 2):
        known = I.merge_domains(known, rows[batch], batch * 1000)
    return I.fold_domain_status(known, I.classify_crawl(shaped(spark, sf, RESULTS)))


def stored_edges(spark, sf, rows: dict[int, DataFrame] | None = None) -> DataFrame:
    """The merged edges as a written table, as an index that several reads share."""
    return cut_lineage(edges(spark, sf, rows), "index-edges")


def board(spark, sf, stored: DataFrame | None = None) -> DataFrame:
    rows = written_links(spark, sf) if stored is None else None
    e = stored_edges(spark, sf, rows) if stored is None else stored
    return cut_lineage(A.leaderboard(e, cut_lineage(domains(spark, sf, rows), "index-domains")), "board")


# ------------------------------------------------------------------ merges
@query("merge_edges", "WITH " + IDX + " SELECT * FROM idx")
def merge_edges(spark, sf):
    return edges(spark, sf)


@query(
    "merge_new_edges",
    "WITH " + IDX + " SELECT count(*) FILTER (WHERE first_seen = 2000) AS new_edges FROM idx",
)
def merge_new_edges(spark, sf):
    return I.new_edges(merged(spark, sf))


@query("merge_domains", "WITH " + IDX + " SELECT * FROM dom")
def merge_domains(spark, sf):
    return domains(spark, sf)


@query(
    "merge_pages",
    "WITH " + IDX + """ SELECT source AS url, split_part(source, '/', 3) AS domain, min(batch) * 1000 AS first_seen, max(batch) * 1000 AS last_seen
FROM raw GROUP BY 1, 2""",
)
def merge_pages(spark, sf, rows: dict[int, DataFrame] | None = None):
    rows = rows or {batch: links(spark, sf, batch) for batch in (1, 2)}
    pages = empty(spark, PAGE_SCHEMA)
    for batch in (1, 2):
        pages = I.merge_pages(pages, rows[batch], batch * 1000)
    return pages


@query(
    "crawl_status",
    "SELECT domain, CASE WHEN off_topic THEN 'offtopic' WHEN pages > 0 THEN 'crawled' ELSE 'failed' END AS status, error, seq, now FROM (" + RESULTS + ")",
)
def crawl_status(spark, sf):
    return I.classify_crawl(shaped(spark, sf, RESULTS))


@query(
    "merge_meta",
    """SELECT key, arg_max(value, seq) AS value FROM (SELECT 'last-' || o_orderstatus AS key, 'none' AS value, -1 AS seq FROM orders
UNION ALL SELECT 'last-' || event_type, CAST(event_id AS STRING), event_id FROM events) GROUP BY key""",
)
def merge_meta(spark, sf):
    stored = shaped(spark, sf, "SELECT DISTINCT 'last-' || o_orderstatus AS key, 'none' AS value FROM {orders}")
    updates = shaped(
        spark, sf, "SELECT 'last-' || event_type AS key, CAST(event_id AS STRING) AS value, event_id AS seq FROM {events}"
    )
    return I.merge_meta(stored, updates)


@query(
    "align_domains",
    """SELECT c_name AS domain, c_custkey AS first_seen, c_custkey AS last_seen, 1 AS crawled, 0 AS attempts,
CAST(NULL AS STRING) AS last_error, 0 AS offtopic FROM customer""",
)
def align_domains(spark, sf):
    old = shaped(
        spark, sf, "SELECT c_name AS domain, c_custkey AS first_seen, c_custkey AS last_seen, 1 AS crawled FROM {customer}"
    )
    return I.align_domains(old)


# ------------------------------------------------------------------ reads
@query("domain_edges", "WITH " + IDX + " SELECT s AS source_domain, t AS target_domain, w AS weight FROM de")
def domain_edges(spark, sf):
    return I.domain_edges(edges(spark, sf))


@query(
    "domain_edges_all",
    "WITH " + IDX + """ SELECT source_domain, target_domain, count(DISTINCT source_url) AS weight FROM idx
WHERE internal = 0 AND source_domain <> target_domain GROUP BY 1, 2""",
)
def domain_edges_all(spark, sf):
    return I.domain_edges(edges(spark, sf), follow_only=False)


@query("domain_counts", "WITH " + IDX + " SELECT * FROM dc")
def domain_counts(spark, sf):
    return I.domain_counts(edges(spark, sf))


@query(
    "backlinks",
    "WITH " + IDX + """ SELECT source_url AS from_url, source_domain AS from_domain, target_url AS to_url, anchor, nofollow = 1 AS nofollow, last_seen
FROM idx WHERE target_domain = 'nation3.com' AND source_domain <> target_domain
ORDER BY nofollow, last_seen DESC, source_url, target_url LIMIT 200""",
)
def backlinks(spark, sf):
    return I.backlinks(edges(spark, sf), "nation3.com")


@query(
    "referring_domains",
    "WITH " + IDX + """ SELECT source_domain AS domain, count(DISTINCT source_url) AS links, bool_or(nofollow = 0) AS follow FROM idx
WHERE target_domain = 'nation3.com' AND source_domain <> target_domain GROUP BY 1""",
)
def referring_domains(spark, sf):
    return I.referring_domains(edges(spark, sf), "nation3.com")


@query(
    "outbound_domains",
    "WITH " + IDX + """ SELECT target_domain AS domain, count(DISTINCT source_url) AS links FROM idx
WHERE source_domain = 'nation3.com' AND source_domain <> target_domain GROUP BY 1""",
)
def outbound_domains(spark, sf):
    return I.outbound_domains(edges(spark, sf), "nation3.com")


@query(
    "index_stats",
    "WITH " + IDX + """ SELECT (SELECT count(*) FROM dom) AS domains, (SELECT count(*) FROM dom WHERE crawled = 1) AS crawled_domains,
(SELECT count(DISTINCT source_url) FROM idx) AS pages, count(*) AS edges, count(*) FILTER (WHERE source_domain <> target_domain) AS cross_domain_edges FROM idx""",
)
def index_stats(spark, sf):
    rows = written_links(spark, sf)
    return I.index_stats(domains(spark, sf, rows), merge_pages(spark, sf, rows), edges(spark, sf, rows))


WAITING = """, wait AS (SELECT target_domain AS domain, count(DISTINCT source_domain) AS refdoms, min(target_url) AS url FROM idx
JOIN dom ON dom.domain = target_domain WHERE internal = 0 AND crawled = 0 AND attempts < 3 AND offtopic = 0 GROUP BY 1 HAVING refdoms >= 2)"""


@query(
    "frontier",
    "WITH " + IDX + WAITING + " SELECT domain, refdoms, url FROM wait WHERE domain <> 'nation7.com' ORDER BY refdoms DESC, domain LIMIT 20",
)
def frontier(spark, sf):
    return I.frontier(edges(spark, sf), domains(spark, sf), limit=20, min_referring=2, skip=["Nation7.com "])


@query(
    "frontier_anchors",
    "WITH " + IDX + WAITING + """ SELECT target_domain AS domain, anchor, count(*) AS links FROM idx WHERE internal = 0
AND target_domain IN (SELECT domain FROM wait ORDER BY refdoms DESC, domain LIMIT 20) GROUP BY 1, 2""",
)
def frontier_anchors(spark, sf):
    e = stored_edges(spark, sf)
    return I.frontier_anchors(e, I.frontier(e, domains(spark, sf), limit=20, min_referring=2))


@query("frontier_size", "WITH " + IDX + WAITING + " SELECT count(*) AS waiting FROM wait")
def frontier_size(spark, sf):
    return I.frontier_size(edges(spark, sf), domains(spark, sf), min_referring=2)


@query(
    "frontier_expand",
    "WITH " + IDX + WAITING + """, found AS (SELECT * FROM wait ORDER BY refdoms DESC, domain LIMIT 8),
topical AS (SELECT DISTINCT target_domain AS domain FROM idx WHERE internal = 0 AND regexp_matches(anchor, 'blue ring|steel') UNION SELECT domain FROM found WHERE contains(domain, 'nation1')),
v AS (SELECT *, CASE WHEN domain = 'nation11.com' THEN 'given' WHEN domain NOT IN (SELECT domain FROM topical) THEN 'topic' ELSE 'take' END AS k FROM found)
SELECT domain, url, refdoms, CASE WHEN k = 'take' AND row_number() OVER (PARTITION BY k ORDER BY refdoms DESC, domain) > 2 THEN 'spare' ELSE k END AS verdict FROM v""",
)
def frontier_expand(spark, sf):
    rows = written_links(spark, sf)
    return I.expand(
        stored_edges(spark, sf, rows), domains(spark, sf, rows), 2, terms=["blue ring", "Steel", "nation1"], seeds_given=["nation11.com"], min_referring=2
    )


# ------------------------------------------------------------------ authority
@query("domain_pagerank", "WITH RECURSIVE " + IDX + RANK + " SELECT domain, round(rank, 6) AS pagerank FROM pr")
def domain_pagerank(spark, sf):
    # each step's table and shuffles are gone before the next but one, and the pairs are worked out once; ranks read no anchors
    space = Workspace(spark, "domain-edges")
    index = empty(spark, EDGE_SCHEMA)
    for batch in (1, 2):
        rows = space.table(links(spark, sf, batch).withColumn("anchor", F.lit("")), "links")
        index = space.table(I.merge_edges(index, rows, batch * 1000).select(*I.EDGE_COLUMNS), f"index{batch}")
        space.keep(f"-index{batch}")
    pairs = space.table(I.domain_edges(index), "pairs")
    space.keep("-pairs")
    ranks = A.pagerank(pairs)
    return ranks.select("domain", F.round("pagerank", 6).alias("pagerank"))


@query(
    "leaderboard",
    "WITH RECURSIVE " + IDX + BOARD + """ SELECT domain, authority, round(pagerank, 6) AS pagerank, referring_domains, backlinks, crawled, utility, thin
FROM board""",
)
def leaderboard(spark, sf):
    return board(spark, sf).withColumn("pagerank", F.round("pagerank", 6))


@query(
    "ranking",
    "WITH RECURSIVE " + IDX + BOARD + """ SELECT domain, authority, referring_domains FROM board WHERE NOT utility AND NOT thin AND contains(domain, 'nation1')
ORDER BY authority DESC, referring_domains DESC, backlinks DESC, domain LIMIT 10""",
)
def ranking(spark, sf):
    return A.ranking(board(spark, sf), q="Nation1").select("domain", "authority", "referring_domains")


@query(
    "ranking_hidden",
    "WITH RECURSIVE " + IDX + BOARD + " SELECT count(*) FILTER (WHERE utility) AS hidden, count(*) FILTER (WHERE thin AND NOT utility) AS thin FROM board",
)
def ranking_hidden(spark, sf):
    return A.hidden_counts(board(spark, sf))


DETAIL = BOARD + """, refs AS (SELECT i.target_domain AS domain, i.source_domain AS other, count(DISTINCT source_url) AS links, bool_or(nofollow = 0) AS follow
  FROM idx i WHERE source_domain <> target_domain GROUP BY 1, 2),
top AS (SELECT refs.domain, other, links, follow, coalesce(b.authority, 0) AS authority,
  row_number() OVER (PARTITION BY refs.domain ORDER BY coalesce(b.authority, 0) DESC, links DESC, other) AS place FROM refs LEFT JOIN board b ON b.domain = other
  QUALIFY place <= 60)"""


@query("domain_detail_referring", "WITH RECURSIVE " + IDX + DETAIL + " SELECT * FROM top")
def domain_detail_referring(spark, sf):
    e = stored_edges(spark, sf)
    return I.detail_lists(e, board(spark, sf, e))["referring"]


@query(
    "domain_detail_outbound",
    "WITH RECURSIVE " + IDX + DETAIL + """ SELECT x.domain, x.other, x.links, x.place, coalesce(b.authority, 0) AS authority FROM (
  SELECT source_domain AS domain, target_domain AS other, count(DISTINCT source_url) AS links,
    row_number() OVER (PARTITION BY source_domain ORDER BY count(DISTINCT source_url) DESC, target_domain) AS place
  FROM idx WHERE source_domain <> target_domain GROUP BY 1, 2 QUALIFY place <= 10) x LEFT JOIN board b ON b.domain = x.other""",
)
def domain_detail_outbound(spark, sf):
    e = stored_edges(spark, sf)
    return I.detail_lists(e, board(spark, sf, e), k=10)["outbound"]


@query(
    "domain_detail_backlinks",
    "WITH RECURSIVE " + IDX + """ SELECT target_domain AS domain, source_url AS from_url, source_domain AS from_domain, target_url AS to_url, anchor,
  nofollow = 1 AS nofollow, last_seen, row_number() OVER (PARTITION BY target_domain ORDER BY nofollow, last_seen DESC, source_url, target_url) AS place
FROM idx WHERE source_domain <> target_domain QUALIFY place <= 60""",
)
def domain_detail_backlinks(spark, sf):
    blank = empty(spark, "domain string, authority int")
    return I.detail_lists(edges(spark, sf), blank)["backlinks"]


@query(
    "link_intersect",
    "WITH RECURSIVE " + IDX + DETAIL.replace("\n  QUALIFY place <= 60", "") + """, riv AS (SELECT * FROM top WHERE domain <> 'nation3.com' AND other <> 'nation3.com'
  AND other NOT IN (SELECT other FROM top WHERE domain = 'nation3.com')),
named AS (SELECT riv.other, riv.domain, row_number() OVER (PARTITION BY riv.other ORDER BY b.authority DESC, b.referring_domains DESC, b.backlinks DESC, riv.domain) AS n
  FROM riv JOIN board b ON b.domain = riv.domain)
SELECT riv.other AS domain, max(riv.authority) AS authority, count(DISTINCT riv.domain) AS rivals,
  (SELECT string_agg(named.domain, ',' ORDER BY n) FROM named WHERE named.other = riv.other AND n <= 4) AS first_rivals
FROM riv GROUP BY riv.other ORDER BY rivals DESC, authority DESC, domain LIMIT 40""",
)
def link_intersect(spark, sf):
    e = stored_edges(spark, sf)
    b = board(spark, sf, e)
    out = A.link_intersect(I.scored_referrers(e, b), b, "nation3.com")
    return out.withColumn("first_rivals", F.array_join("first_rivals", ","))


# shops, and the customers that link to them by what they bought there
BUYERS = """SELECT DISTINCT 'shop' || CAST(l_suppkey AS STRING) AS domain, 'buyer' || CAST(o_custkey AS STRING) AS other,
  CAST(o_custkey % 100 AS INT) AS authority FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
SHOPS = """SELECT 'shop' || CAST(s_suppkey AS STRING) AS domain, CAST(s_suppkey % 50 AS INT) AS authority, s_nationkey AS referring_domains,
  s_suppkey AS backlinks FROM {supplier}"""


@query(
    "link_intersect_shops",
    "WITH refs AS (" + BUYERS + "), board AS (" + SHOPS + """), riv AS (SELECT * FROM refs WHERE domain <> 'shop3' AND other NOT IN (SELECT other FROM refs WHERE domain = 'shop3')),
best AS (SELECT other, max(authority) AS authority, count(*) AS rivals FROM riv GROUP BY 1 ORDER BY rivals DESC, authority DESC, other LIMIT 40),
named AS (SELECT riv.other, riv.domain, row_number() OVER (PARTITION BY riv.other ORDER BY b.authority DESC, referring_domains DESC, backlinks DESC, riv.domain) AS n
  FROM riv JOIN best USING (other) JOIN board b ON b.domain = riv.domain)
SELECT other AS domain, authority, rivals, (SELECT string_agg(domain, ',' ORDER BY n) FROM named WHERE named.other = best.other AND n <= 4) AS first_rivals FROM best""",
)
def link_intersect_shops(spark, sf):
    out = A.link_intersect(shaped(spark, sf, BUYERS), shaped(spark, sf, SHOPS), "shop3")
    return out.withColumn("first_rivals", F.array_join("first_rivals", ","))


@query("intersect_choices", "WITH RECURSIVE " + IDX + BOARD + " SELECT domain FROM board WHERE crawled")
def intersect_choices(spark, sf):
    return A.intersect_choices(board(spark, sf))


@query(
    "outbound_external",
    "WITH " + IDX + """, ext AS (SELECT *, target_url AS t FROM idx WHERE internal = 0), an AS (
  SELECT target_domain AS domain, anchor, row_number() OVER (PARTITION BY target_domain ORDER BY source_url, target_url) AS n FROM ext WHERE anchor <> '')
SELECT target_domain AS domain, count(*) AS links, count(DISTINCT source_url) AS from_pages, count(*) FILTER (WHERE nofollow = 1) AS nofollow,
  (SELECT string_agg(anchor, '|' ORDER BY n) FROM an WHERE an.domain = ext.target_domain AND n <= 5) AS anchors
FROM ext GROUP BY 1 ORDER BY links DESC, domain LIMIT 40""",
)
def outbound_external(spark, sf):
    from webloom.operators.links import outbound_external as op

    e = edges(spark, sf).select(
        F.col("source_url").alias("source"), F.col("target_url").alias("target"), "anchor",
        (F.col("internal") == 1).alias("internal"), (F.col("nofollow") == 1).alias("nofollow"),
        F.col("source_url").alias("page_id"), F.lit(0).alias("pos"),
    )
    return op(e).withColumn("anchors", F.array_join("anchors", "|"))
