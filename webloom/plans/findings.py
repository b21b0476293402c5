"""Queries on findings: merge, order, summary, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import findings as G
from webloom.operators import links as L
from webloom.plans.registry import query, shaped, table
from webloom.plans.rules import GUILTY, shop_findings
from webloom.sources.pages import spread

W = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
MERGED = "WITH " + GUILTY + """, m AS (SELECT category, title, arg_min(severity, k) AS severity, arg_min(url, k) AS url, CAST(sum(occurrences) AS BIGINT) AS occurrences,
  min(k) AS k, list(url ORDER BY k)[2:26] AS others FROM g GROUP BY 1, 2)"""


def merged(spark, sf):
    return G.merge_findings(shop_findings(spark, sf))


@query("merge_findings", MERGED + " SELECT category, title, severity, url, occurrences, array_to_string(others, ' ') AS others FROM m")
def merge_findings(spark, sf):
    return merged(spark, sf).select("category", "title", "severity", "url", "occurrences", F.array_join("other_urls", " ").alias("others"))


@query("order_findings", MERGED + f" SELECT title, row_number() OVER (ORDER BY {W}, occurrences DESC, category, k, title) AS place FROM m ORDER BY 2 LIMIT 5")
def order_findings(spark, sf):
    """The first five; numbered after the limit, on five rows."""
    from pyspark.sql import Window

    top = G.order_findings(merged(spark, sf)).limit(5)
    w = Window.orderBy(G.weight("severity"), F.desc("occurrences"), "category", "seq", "title")
    return top.select("title", F.row_number().over(w).cast("long").alias("place"))


@query(
    "finding_ids",
    "WITH " + GUILTY + """ SELECT url, title, left(sha1(category || '|' || title || '|' || url || '|' || CASE WHEN title LIKE 'Clickable items%' THEN 'div'
  WHEN title LIKE 'Contact link%' OR title LIKE 'Links open%' THEN 'a' WHEN title LIKE 'Field says%' OR title LIKE 'Personal-data%' THEN '#e'
  WHEN title LIKE 'Fields rely%' OR title LIKE 'Form fields%' THEN 'input' WHEN title LIKE 'Images without%' THEN CASE k % 4 WHEN 1 THEN 'img' ELSE '#pic' END
  ELSE '' END), 12) AS id, left(sha1(category || '|' || title), 12) AS group_id FROM g""",
)
def finding_ids(spark, sf):
    f = shop_findings(spark, sf)
    return f.select("url", "title", G.finding_id().alias("id"), G.group_id().alias("group_id"))


@query(
    "finding_summary",
    MERGED + """ SELECT 'severity' AS kind, severity AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'total', '', count(*) FROM m""",
)
def finding_summary(spark, sf):
    return G.summary(merged(spark, sf))


@query("run_meta", "SELECT (SELECT count(*) FROM orders) AS pages_tested, (SELECT count(*) FROM part) AS links_checked, CAST(sum(o_custkey % 5) AS BIGINT) AS controls_clicked, CAST(sum(o_custkey % 3) AS BIGINT) AS forms_tested FROM orders")
def run_meta(spark, sf):
    pages = shaped(spark, sf, "SELECT o_custkey % 5 AS buttons_clicked, o_custkey % 3 AS forms_tested FROM {orders}")
    return G.run_meta(pages, table(spark, sf, "part"))


@query("severity_gate", MERGED + " SELECT bool_or(severity = 'critical') AS critical, bool_or(severity IN ('critical', 'high')) AS high FROM m")
def severity_gate(spark, sf):
    f = merged(spark, sf)
    return f.agg(F.max(G.weight("severity") <= 0).alias("critical"), F.max(G.weight("severity") <= 1).alias("high"))


@query("finding_search", "WITH " + GUILTY + " SELECT url, title, occurrences FROM g WHERE severity = 'medium' AND (contains(lower(title), 'label') OR title LIKE 'Field says optional%')")
def finding_search(spark, sf):
    return G.search(shop_findings(spark, sf), severity="medium", q=" LABEL ").select("url", "title", "occurrences")


@query("most_urgent", MERGED + f" SELECT title, severity, occurrences FROM m WHERE severity IN ('critical', 'high') ORDER BY {W}, occurrences DESC, category LIMIT 12")
def most_urgent(spark, sf):
    return G.most_urgent(merged(spark, sf)).select("title", "severity", "occurrences")


@query("category_counts", MERGED + " SELECT category, count(*) AS n FROM m GROUP BY 1")
def category_counts(spark, sf):
    return G.category_counts(merged(spark, sf))


@query(
    "page_results",
    """WITH l AS (SELECT page_id, url, len(regexp_extract_all(html, '<a href="/[^"]*">')) AS n FROM pages),
f AS (SELECT url, 2 + CAST(length(trim(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'))) > 65 AS INT) AS n FROM pages)
SELECT url, CAST(sum(l.n) AS BIGINT) AS links_found, CAST(sum(f.n) AS BIGINT) AS findings FROM l JOIN f USING (url) GROUP BY 1""",
)
def page_results(spark, sf):
    from webloom.operators.rules import page_findings

    pages = spread(table(spark, sf, "pages"))
    links = L.extract_links(pages).select("page_url", U.normalise("href", F.col("page_url")).alias("target"))
    found = page_findings(pages)
    return G.page_results(pages, found, links)
