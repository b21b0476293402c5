"""Queries on site intelligence and on stored reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import tech as T
from webloom.plans.registry import query, shaped, table
from webloom.sources.pages import spread

HARVEST = """SELECT o_orderkey AS page_id, 'https://c' || CAST(o_custkey AS STRING) || '.example.com/shop' AS url, o_orderkey % 2 = 0 AS nginx, o_orderkey % 3 = 0 AS session, o_orderkey % 5 = 0 AS jq,
  o_orderkey % 7 = 0 AS meta_gen, o_orderkey % 11 = 0 AS has_global, '<html><body class="' || CASE WHEN o_orderkey % 13 = 0 THEN 'Framework-X' ELSE o_orderpriority END || '"></body></html>' AS html FROM {orders}"""
FINGERPRINTS = [
    ("Nginx", "header", "Server", "^nginx(?:/([\\d.]+))?\\;version:\\1"), ("PHP", "cookie", "PHPSESSID", ""), ("jQuery", "script_src", None, "jquery[.-]"),
    ("Pressly", "meta", "Generator", "pressly"), ("Pressly", "html", None, "class=\"press"), ("Reactor", "js", "Reactor", ""), ("Short", "js", "$", ""),
    ("FrameX", "html", None, "class=\"framework-x"), ("Broken", "url", None, "(unclosed"), ("Shop", "url", None, "/shop$"),
]
IMPLIES = [("Pressly", "PHP\\;confidence:50"), ("FrameX", "Pressly"), ("PHP", "PHP"), ("Shop", "Unknown"), ("Reactor", "jQuery")]


def harvest(spark, sf):
    h = spread(shaped(spark, sf, HARVEST))
    one = lambda flag, k, v: F.map_from_entries(F.filter(F.array(F.when(F.col(flag), F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")))), lambda e: e.isNotNull()))
    only = lambda flag, v: F.filter(F.array(F.when(F.col(flag), F.lit(v))), lambda e: e.isNotNull())
    return h.select(
        "page_id", "url", "html", one("nginx", "server", "nginx/1.2").alias("headers"), one("meta_gen", "GENERATOR", "Pressly 5").alias("meta"),
        F.when(F.col("session"), "a=b; PHPSESSID=xyz; c").otherwise("a=b").alias("cookies"), only("jq", "/js/JQuery.min.js").alias("script_src"),
        F.array().cast("array<string>").alias("scripts"), F.when(F.col("has_global"), F.array(F.lit("Reactor"), F.lit("$"))).alias("globals"),
    )


def book(spark):
    return spark.createDataFrame(FINGERPRINTS, "tech string, field string, key string, pattern string")


FOUND = "h AS (" + HARVEST + """), f AS (SELECT page_id, 'Nginx' AS tech FROM h WHERE nginx UNION SELECT page_id, 'PHP' FROM h WHERE session UNION SELECT page_id, 'jQuery' FROM h WHERE jq
  UNION SELECT page_id, 'Pressly' FROM h WHERE meta_gen UNION SELECT page_id, 'Reactor' FROM h WHERE has_global UNION SELECT page_id, 'FrameX' FROM h WHERE page_id % 13 = 0 UNION SELECT page_id, 'Shop' FROM h)"""
ALL = FOUND + """, a AS (SELECT * FROM f UNION SELECT page_id, 'Pressly' FROM f WHERE tech = 'FrameX' UNION SELECT page_id, 'PHP' FROM f WHERE tech IN ('FrameX', 'Pressly')
  UNION SELECT page_id, 'jQuery' FROM f WHERE tech = 'Reactor'),
c AS (SELECT page_id, tech, CASE tech WHEN 'Nginx' THEN 'Web servers' WHEN 'PHP' THEN 'Programming languages' WHEN 'Pressly' THEN 'CMS' WHEN 'Shop' THEN 'Ecommerce' ELSE 'Other' END AS category FROM a)"""


@query("detect_tech", "WITH " + FOUND + " SELECT * FROM f")
def detect_tech(spark, sf):
    return T.detect_tech(harvest(spark, sf), book(spark))


def with_implied(spark, sf):
    implies = spark.createDataFrame(IMPLIES, "tech string, implied string")
    return T.implied(detect_tech(spark, sf), implies, book(spark).select("tech").distinct())


@query("implied_tech", "WITH " + ALL + " SELECT * FROM a")
def implied_tech(spark, sf):
    return with_implied(spark, sf)


def categorised(spark, sf):
    cats = spark.createDataFrame([("Nginx", 0, 22), ("PHP", 0, 27), ("Pressly", 0, 1), ("Pressly", 1, 27), ("Shop", 0, 6)], "tech string, pos int, cat_id int")
    names = spark.createDataFrame([(22, "Web servers"), (27, "Programming languages"), (1, "CMS"), (6, "Ecommerce")], "cat_id int, name string")
    return T.tech_categories(with_implied(spark, sf), cats, names)


@query("tech_categories", "WITH " + ALL + " SELECT * FROM c")
def tech_categories(spark, sf):
    return categorised(spark, sf)


@query(
    "tech_display",
    "WITH " + ALL + """, g AS (SELECT page_id, category, string_agg(tech, ',' ORDER BY tech) AS techs, CASE category WHEN 'CMS' THEN 1 WHEN 'Ecommerce' THEN 2 WHEN 'Programming languages' THEN 5 WHEN 'Web servers' THEN 6 ELSE 99 END AS r FROM c GROUP BY 1, 2)
SELECT page_id, category, techs, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY r, category) AS place FROM g) WHERE place <= 3""",
)
def tech_display(spark, sf):
    return T.tech_display(categorised(spark, sf), categories=3).withColumn("techs", F.array_join("techs", ","))


@query(
    "hosting_facts",
    """SELECT c_custkey, 'c' || c_custkey || '.example.com' AS host, 'https' AS scheme, CASE c_custkey % 4 WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'nginx' END AS server,
CASE WHEN c_custkey % 4 = 0 THEN 'Cloudflare' WHEN c_custkey % 3 = 0 THEN 'Amazon CloudFront' WHEN c_custkey % 5 = 0 THEN 'CDN (x-cache)' END AS cdn FROM customer""",
)
def hosting_facts(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.format_string("https://c%d.example.com:8443/", "c_custkey").alias("url"))
    pair = lambda when, k, v: F.when(when, F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")))
    k = F.col("c_custkey")
    heads = F.array(pair(k % 4 == 0, "Server", "cloudflare"), pair(k % 4 == 1, "SERVER", "nginx"), pair(k % 3 == 0, "X-Amz-Cf-Id", "q"), pair(k % 5 == 0, "X-Cache", "HIT"))
    c = c.withColumn("headers", F.map_from_entries(F.filter(heads, lambda e: e.isNotNull())))
    return T.hosting(c).select("c_custkey", "host", "scheme", "server", "cdn")


OPR = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'oops' WHEN 1 THEN '{"response":[{"status_code":404}]}' ELSE
  '{"response":[{"status_code":200,"page_rank_decimal":' || CAST(p_size AS STRING) || '.25,"rank":"' || CAST(p_partkey AS STRING) || '"}]}' END AS body FROM {part}"""


@query(
    "authority_answers",
    """SELECT p_partkey AS id, p_partkey % 4 <> 0 AS available, p_partkey % 4 IN (2, 3) AS found, CASE WHEN p_partkey % 4 IN (2, 3) THEN p_size + 0.25 END::DOUBLE AS score,
CASE WHEN p_partkey % 4 IN (2, 3) THEN CAST(p_partkey AS STRING) END AS rank FROM part""",
)
def authority_answers(spark, sf):
    return T.parse_authority(shaped(spark, sf, OPR)).drop("body")


PSI = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{"error":{"message":"quota"}}' WHEN 1 THEN 'nope' ELSE
  '{"lighthouseResult":{"categories":{"performance":{"score":0.' || CAST(10 + p_size AS STRING) || '}},"audits":{"speed-index":{"displayValue":"' || CAST(p_size AS STRING) || ' s"},"other":{}}},"loadingExperience":{"metrics":' ||
  '{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":' || CAST(p_size * 100 AS STRING) || ',"category":"FAST"}},"overall_category":"SLOW"}}' END AS body FROM {part}"""


@query(
    "page_speed_answers",
    """SELECT p_partkey AS id, p_partkey % 5 > 1 AS available, CASE p_partkey % 5 WHEN 0 THEN 'PageSpeed error: quota' WHEN 1 THEN 'The page-speed service did not respond.' END AS reason,
CASE WHEN p_partkey % 5 > 1 THEN CAST(10 + p_size AS INT) END AS lab_score, CASE WHEN p_partkey % 5 > 1 THEN p_size || ' s' END AS si,
CASE WHEN p_partkey % 5 > 1 THEN CASE WHEN p_size >= 10 THEN printf('%.2f s', p_size / 10.0) ELSE printf('%d ms', p_size * 100) END ELSE '—' END AS lcp,
CASE WHEN p_partkey % 5 > 1 THEN 'good' ELSE '—' END AS lcp_rating, CASE WHEN p_partkey % 5 > 1 THEN 'poor' ELSE '—' END AS overall FROM part""",
)
def page_speed_answers(spark, sf):
    p = T.parse_page_speed(shaped(spark, sf, PSI))
    lcp = F.try_element_at("field", F.lit("lcp_ms"))
    return p.select(
        "id", "available", "reason", "lab_score", F.try_element_at("lab", F.lit("si")).alias("si"), T.milliseconds(lcp["percentile"].cast("string")).alias("lcp"),
        T.rating(lcp["category"]).alias("lcp_rating"), T.rating(F.col("overall")).alias("overall"),
    )
