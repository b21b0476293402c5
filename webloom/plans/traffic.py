"""Queries on captured traffic, shaped from events, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import predicates as P
from webloom.operators import crawl as C
from webloom.operators import traffic as N
from webloom.plans.registry import query, shaped, table

CONSOLE = """SELECT 'https://u' || CAST(user_id AS STRING) || '.example.com/' AS page_url, event_id AS seq, 'main.js:1' AS location,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'log' END AS type,
  CASE event_id % 4 WHEN 0 THEN 'Failed to load widget ' || props WHEN 1 THEN 'GET /Favicon.ico 404' WHEN 2 THEN 'Deprecated call' ELSE 'hello' END AS text FROM {events}"""
ERRORS = """SELECT 'https://u' || CAST(user_id AS STRING) || '.example.com/' AS page_url, event_id AS seq, 'at x' AS stack,
  CASE event_id % 3 WHEN 0 THEN 'f is not a function ' || props WHEN 1 THEN 'Clipboard write was denied' ELSE 'clipboard empty' END AS message FROM {events} WHERE event_type = 'error'"""


@query(
    "console_findings",
    "WITH c AS (" + CONSOLE + "), e AS (" + ERRORS + """), d AS (SELECT page_url, left(text, 120) AS k, arg_min(type, seq) AS type, arg_min(text, seq) AS text FROM c
  WHERE NOT regexp_matches(text, '(?i)favicon.ico') GROUP BY 1, 2)
SELECT page_url AS url, 'critical' AS severity, 'Uncaught JS exception: ' || message AS title FROM e WHERE seq % 3 <> 1
UNION ALL SELECT page_url, 'high', 'console.error: ' || text FROM d WHERE type = 'error'
UNION ALL SELECT page_url, 'low', 'console.warn: ' || text FROM d WHERE type = 'warning' AND regexp_matches(text, '(?i)deprecat|failed')""",
)
def console_findings(spark, sf):
    return N.console_findings(shaped(spark, sf, CONSOLE), shaped(spark, sf, ERRORS)).select("url", "severity", "title")


FAILED = """SELECT 'https://shop.example.com/' || o_orderstatus AS page_url, o_orderkey AS seq, 'https://cdn.example.com/lib/' || CAST(o_custkey AS STRING) || '/a-rather-long-file-name-for-a-script-of-this-kind.min.js' AS url,
  'GET' AS method, 'script' AS resource_type, CASE o_orderkey % 3 WHEN 0 THEN 'net::ERR_ABORTED' WHEN 1 THEN 'net::ERR_FAILED' ELSE NULL END AS failure FROM {orders}"""


@query(
    "failed_requests",
    "WITH f AS (" + FAILED + """) SELECT seq, page_url AS url, 'Request failed: ' || CASE WHEN length(url) <= 80 THEN url ELSE left(url, 65) || '…' || right(url, 14) END AS title,
coalesce(failure, 'unknown') AS failure FROM f WHERE seq % 3 <> 0""",
)
def failed_requests(spark, sf):
    return N.failed_requests(shaped(spark, sf, FAILED)).select("seq", "url", "title", F.col("evidence")["failure"].alias("failure"))


RESPONSES = """SELECT 'https://shop.example.com/c/' || CAST(o_custkey % 50 AS STRING) AS page_url, o_orderkey AS seq, 'GET' AS method, CAST(floor(o_totalprice) AS BIGINT) AS size,
  CASE o_orderkey % 7 WHEN 0 THEN 'https://api.example.com/v1/session' WHEN 1 THEN 'https://api.example.com/list?q=' || CAST(o_custkey % 5 AS STRING)
    ELSE 'https://api.example.com/item/' || CAST(o_custkey % 20 AS STRING) END AS url,
  CASE o_orderkey % 11 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 429 WHEN 4 THEN 403 WHEN 5 THEN 422 ELSE 200 END AS status,
  CASE WHEN o_orderkey % 7 IN (0, 1) THEN 'xhr' ELSE 'image' END AS resource_type,
  CASE WHEN o_orderkey % 7 = 1 THEN '{"message": "No results for this query"}' ELSE 'denied' END AS body FROM {orders}"""
BAD = "WITH r AS (" + RESPONSES + """), b AS (SELECT page_url, url, status, arg_min(resource_type, seq) AS resource_type, arg_min(body, seq) AS body, min(seq) AS seq FROM r WHERE status >= 400 GROUP BY 1, 2, 3)"""


@query("bad_responses", BAD + " SELECT page_url, url, status, resource_type, seq FROM b")
def bad_responses(spark, sf):
    return N.bad_responses(shaped(spark, sf, RESPONSES)).select("page_url", "url", "status", "resource_type", "seq")


@query(
    "network_findings",
    BAD + """, p AS (SELECT *, resource_type = 'xhr' AND status IN (400, 401, 403) AND contains(url, 'session') AS probe,
  resource_type = 'xhr' AND status IN (400, 404, 409, 422) AND contains(url, 'list') AS mild, regexp_extract(page_url, '[0-9]+$')::INT % 2 = 0 AS shows FROM b)
SELECT page_url AS url, 'info' AS severity, 'Sign-in checks answer ''not signed in'' (normal for visitors)' AS title, count(*) AS n FROM p WHERE probe GROUP BY 1
UNION ALL SELECT page_url, CASE WHEN shows THEN 'medium' ELSE 'low' END, 'API answers ' || status || ' for an empty result' || CASE WHEN shows THEN '' ELSE ' (the page shows no error)' END || ': ' || url, 1 FROM p WHERE mild
UNION ALL SELECT page_url, CASE WHEN status >= 500 THEN 'critical' WHEN status = 429 THEN 'medium' ELSE 'high' END, 'HTTP ' || status || ' on ' || resource_type || ': ' || url, 1 FROM p WHERE NOT probe AND NOT mild""",
)
def network_findings(spark, sf):
    bad = N.bad_responses(shaped(spark, sf, RESPONSES))
    texts = shaped(
        spark, sf,
        "SELECT DISTINCT 'https://shop.example.com/c/' || CAST(o_custkey % 50 AS STRING) AS page_url, CASE WHEN o_custkey % 50 % 2 = 0 THEN 'Something went wrong here' ELSE 'All errorless' END AS text FROM {orders}",
    )
    f = N.network_findings(bad, texts)
    n = F.when(F.col("severity") == "info", F.size(F.split(F.col("evidence")["codes"], "/"))).otherwise(1)
    return f.select("url", "severity", "title", n.cast("long").alias("n"))


@query("page_weight", "WITH r AS (" + RESPONSES + ") SELECT page_url, round(sum(size) / 1024.0, 4) AS weight_kb, count(*) AS requests FROM r GROUP BY 1")
def page_weight(spark, sf):
    return N.page_weight(shaped(spark, sf, RESPONSES)).withColumn("weight_kb", F.round("weight_kb", 4))


@query(
    "http_findings",
    "WITH r AS (" + RESPONSES + ") SELECT seq, CASE WHEN status >= 500 THEN 'critical' ELSE 'high' END AS severity, 'Page returns HTTP ' || status AS title FROM r WHERE status >= 400",
)
def http_findings(spark, sf):
    return N.http_findings(shaped(spark, sf, RESPONSES)).select("seq", "severity", "title")


HEADERS = """SELECT c_custkey AS seq, CASE WHEN c_custkey % 4 = 0 THEN 'http://' ELSE 'https://' END || 'c' || CAST(c_custkey AS STRING) || '.example.com/' AS page_url, CASE WHEN c_custkey % 13 = 0 THEN 500 ELSE 200 END AS status,
  c_custkey % 2 = 0 AS csp, c_custkey % 3 = 0 AS framed, c_custkey % 5 = 0 AS nosniff, c_custkey % 7 = 0 AS hsts, c_custkey % 6 = 0 AS banner FROM {customer}"""


@query(
    "header_findings",
    "WITH h AS (" + HEADERS + """ WHERE c_custkey % 13 <> 0) SELECT seq, 'Missing security header: Content-Security-Policy' AS title, 'low' AS severity FROM h WHERE NOT csp
UNION ALL SELECT seq, 'Missing security header: X-Content-Type-Options', 'low' FROM h WHERE NOT nosniff UNION ALL SELECT seq, 'Missing security header: Referrer-Policy', 'info' FROM h
UNION ALL SELECT seq, 'Missing security header: X-Frame-Options', 'low' FROM h WHERE NOT (csp AND framed)
UNION ALL SELECT seq, 'Missing security header: Strict-Transport-Security', 'low' FROM h WHERE NOT hsts AND page_url LIKE 'https%'
UNION ALL SELECT seq, 'Server software and version are advertised in response headers', 'info' FROM h WHERE banner""",
)
def header_findings(spark, sf):
    h = shaped(spark, sf, HEADERS)
    pair = lambda when, k, v: F.when(when, F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")))
    pairs = F.array(
        F.struct(F.lit("Content-Type").alias("k"), F.lit("text/html").alias("v")),
        pair(F.expr("csp AND framed"), "Content-Security-Policy", "Frame-Ancestors 'self'"), pair(F.expr("csp AND NOT framed"), "content-security-policy", "default-src *"),
        pair(F.col("nosniff"), "X-Content-Type-Options", "nosniff"), pair(F.col("hsts"), "Strict-Transport-Security", "max-age=1"), pair(F.col("banner"), "Server", "nginx/1.25"),
    )
    h = h.withColumn("headers", F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull())))
    return N.header_findings(h).select((F.floor(F.col("seq") / 10)).alias("seq"), "title", "severity")


TIMINGS = """SELECT event_id AS seq, 'https://u' || CAST(user_id AS STRING) || '.example.com/' AS page_url, value * 100 AS load_ms, value * 20 AS ttfb_ms, value * 50 AS weight_kb, 3 AS requests FROM {events}"""


@query(
    "performance_findings",
    "WITH t AS (" + TIMINGS + """) SELECT seq, CASE WHEN load_ms < 10000 THEN 'medium' ELSE 'high' END AS severity, 'load' AS kind FROM t WHERE load_ms > 5000
UNION ALL SELECT seq, 'medium', 'ttfb' FROM t WHERE ttfb_ms > 1500 UNION ALL SELECT seq, 'low', 'weight' FROM t WHERE weight_kb > 3000""",
)
def performance_findings(spark, sf):
    f = N.performance_findings(shaped(spark, sf, TIMINGS))
    kind = F.when(F.col("title").startswith("Slow page"), "load").when(F.col("title").startswith("Slow server"), "ttfb").otherwise("weight")
    return f.select(F.floor(F.col("seq") / 10).alias("seq"), "severity", kind.alias("kind"))


METRICS = "SELECT p_partkey AS seq, 'https://shop.example.com/item/' || CAST(p_partkey AS STRING) AS page_url, 'mobile' AS label, 390 AS width, 380 + p_size AS scroll_width, p_partkey % 5 = 0 AS clipped FROM {part}"


@query("overflow_findings", "WITH m AS (" + METRICS + ") SELECT seq, 'Horizontal scrolling on mobile (390px)' AS title, CAST(scroll_width - 390 AS STRING) AS over FROM m WHERE NOT clipped AND scroll_width > 394")
def overflow_findings(spark, sf):
    return N.overflow_findings(shaped(spark, sf, METRICS)).select("seq", "title", F.col("evidence")["overflow_px"].alias("over"))


# every line of an order is an element of its part's page
WIDE = """SELECT 'https://shop.example.com/item/' || CAST(l_partkey AS STRING) AS page_url, 'mobile' AS label,
  'div#l' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS selector, CAST(390 + l_suppkey % 40 AS BIGINT) AS right_px FROM {lineitem}"""


@query(
    "overflow_elements",
    "WITH m AS (" + METRICS + "), e AS (" + WIDE + """), w AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY right_px DESC, selector) AS place FROM e)
SELECT m.seq, '[' || coalesce(string_agg('{"selector":"' || selector || '","right":' || right_px || '}', ',' ORDER BY place), '') || ']' AS widest
FROM m LEFT JOIN w ON w.page_url = m.page_url AND place <= 5 WHERE NOT clipped AND scroll_width > 394 GROUP BY m.seq""",
)
def overflow_elements(spark, sf):
    elements = shaped(spark, sf, WIDE).withColumnRenamed("right_px", "right")
    return N.overflow_findings(shaped(spark, sf, METRICS), elements).select("seq", F.col("evidence")["widest_elements"].alias("widest"))


# ------------------------------------------------------------------ site probes: one site per customer
PROBES = """SELECT CASE WHEN c_custkey % 6 = 0 THEN 'http://' ELSE 'https://' END || 'c' || CAST(c_custkey AS STRING) || '.example.com' AS site, kind, path, c_custkey AS k, c_custkey * 100 + n AS seq,
  CASE WHEN c_custkey % 17 = 0 THEN 403 WHEN kind = 'root' THEN 200
    WHEN kind = 'robots' THEN CASE c_custkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 4 THEN NULL ELSE 200 END
    WHEN kind = 'sitemap' THEN CASE c_custkey % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 ELSE 200 END
    WHEN kind = 'unknown' THEN CASE c_custkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 500 ELSE 404 END
    WHEN kind = 'http' THEN 200 WHEN c_custkey % 3 = 0 THEN 200 ELSE 404 END AS status,
  CASE WHEN kind = 'robots' AND c_custkey % 5 = 2 THEN 'text/html; charset=utf-8' ELSE 'text/plain' END AS content_type,
  CASE kind WHEN 'robots' THEN 'User-agent: *' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'Disallow: /' ELSE 'Disallow: /admin' END || chr(10)
    WHEN 'sitemap' THEN CASE WHEN c_custkey % 7 = 2 THEN '<!doctype html><html></html>' ELSE '<?xml?><urlset></urlset>' END
    WHEN 'file' THEN CASE WHEN c_custkey % 9 = 0 THEN ' <!DOCTYPE html><p>' WHEN path = '/package.json' AND c_custkey % 2 = 0 THEN 'name: x' ELSE '{"a": 1}' END ELSE '' END AS body,
  CASE WHEN kind = 'http' AND c_custkey % 8 = 1 THEN 'http://x/' ELSE 'https://x/' END AS final_url
FROM {customer} CROSS JOIN (VALUES ('root', '/', 1), ('robots', '/robots.txt', 2), ('sitemap', '/sitemap.xml', 3), ('unknown', '/no-such-page-9f2c1a', 4), ('http', '/', 5),
  ('file', '/.env', 6), ('file', '/package.json', 7), ('file', '/.well-known/security.txt', 8)) AS v(kind, path, n)"""
SITES = "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'http://' ELSE 'https://' END || 'c' || c_custkey || '.example.com' AS site, c_custkey % 17 = 0 AS b FROM customer)"


def probes(spark, sf):
    return shaped(spark, sf, PROBES)


@query("site_blocked", SITES + " SELECT site || '/' AS url, 'The site refused the tester (HTTP 403) - this report is incomplete' AS title FROM c WHERE b")
def site_blocked(spark, sf):
    return N.site_blocked(probes(spark, sf)).select("url", "title")


@query(
    "robots_findings",
    SITES + """ SELECT site || '/robots.txt' AS url, CASE k % 5 WHEN 0 THEN 'info' ELSE 'low' END AS severity, 'No robots.txt' AS title FROM c WHERE NOT b AND k % 5 IN (0, 2)
UNION ALL SELECT site || '/robots.txt', 'info', 'Could not check robots.txt' FROM c WHERE NOT b AND k % 5 IN (1, 4)
UNION ALL SELECT site || '/robots.txt', 'medium', 'robots.txt blocks the entire site' FROM c WHERE NOT b AND k % 5 = 3 AND k % 2 = 0""",
)
def robots_findings(spark, sf):
    return N.robots_findings(probes(spark, sf)).select("url", "severity", "title")


@query(
    "sitemap_findings",
    SITES + """ SELECT site || '/sitemap.xml' AS url, 'No sitemap.xml found' AS title FROM c WHERE NOT b AND k % 7 IN (0, 2)
UNION ALL SELECT site || '/sitemap.xml', 'Could not check sitemap.xml' FROM c WHERE NOT b AND k % 7 = 1""",
)
def sitemap_findings(spark, sf):
    return N.sitemap_findings(probes(spark, sf)).select("url", "title")


@query(
    "site_probe_findings",
    SITES + """ SELECT site || '/no-such-page-9f2c1a' AS url, 'medium' AS severity, 'Unknown URLs return HTTP 200 instead of 404' AS title FROM c WHERE NOT b AND k % 4 = 0
UNION ALL SELECT site || '/no-such-page-9f2c1a', 'high', 'Unknown URLs return HTTP 500' FROM c WHERE NOT b AND k % 4 = 1
UNION ALL SELECT site, 'critical', 'Site is served over plain HTTP' FROM c WHERE k % 6 = 0
UNION ALL SELECT 'http://' || substr(site, 9) || '/', 'high', 'HTTP is served without redirecting to HTTPS' FROM c WHERE NOT b AND k % 6 <> 0 AND k % 8 = 1
UNION ALL SELECT site || '/.env', 'critical', 'Environment file with secrets is publicly reachable: /.env' FROM c WHERE NOT b AND k % 3 = 0 AND k % 9 <> 0
UNION ALL SELECT site || '/package.json', 'info', 'Dependency manifest is publicly reachable: /package.json' FROM c WHERE NOT b AND k % 3 = 0 AND k % 9 <> 0 AND k % 2 = 1
UNION ALL SELECT site || '/.well-known/security.txt', 'info', 'No security.txt' FROM c WHERE NOT b AND k % 3 <> 0""",
)
def site_probe_findings(spark, sf):
    return N.site_probe_findings(probes(spark, sf)).select("url", "severity", "title")


# ------------------------------------------------------------------ links, titles, accessibility
LINKS = """SELECT 'https://shop.example.com/o/' || CAST(l_orderkey AS STRING) AS source, CASE WHEN l_partkey % 3 = 0 THEN 'https://other.example.org/' ELSE 'https://shop.example.com/' END || CAST(l_partkey AS STRING) AS target,
  l_returnflag AS text, l_partkey % 3 <> 0 AS internal, l_orderkey * 10 + l_linenumber AS seq FROM {lineitem}"""
LINK_PROBES = """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'https://other.example.org/' ELSE 'https://shop.example.com/' END || CAST(p_partkey AS STRING) AS url, m AS method,
  CASE WHEN m = 'HEAD' THEN CASE p_partkey % 6 WHEN 0 THEN 405 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN NULL ELSE 200 END
    ELSE CASE p_partkey % 6 WHEN 0 THEN 200 WHEN 2 THEN 401 ELSE CASE WHEN p_partkey % 12 = 3 THEN NULL ELSE 500 END END END AS status
FROM {part} CROSS JOIN (VALUES ('HEAD'), ('GET')) AS v(m)"""
ANSWER = "CASE k % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 401 WHEN 3 THEN CASE WHEN k % 12 = 3 THEN NULL ELSE 500 END ELSE 200 END"


@query("effective_probe", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'https://other.example.org/' ELSE 'https://shop.example.com/' END || p_partkey AS url, " + ANSWER.replace("k %", "p_partkey %") + " AS status FROM part")
def effective_probe(spark, sf):
    return N.effective_probe(shaped(spark, sf, LINK_PROBES))


@query(
    "link_findings",
    "WITH l AS (SELECT *, regexp_extract(target, '[0-9]+$')::INT AS k FROM (" + LINKS + ")), t AS (SELECT target, k, internal, " + ANSWER + """ AS status, count(DISTINCT source) AS n, list_sort(list(DISTINCT source)) AS s FROM l GROUP BY 1, 2, 3)
SELECT CASE WHEN status IS NULL THEN 'Link unreachable: ' ELSE 'HTTP ' || status || ' link: ' END || target AS title, s[1] AS url, n AS occurrences, array_to_string(s[2:8], ' ') AS others,
  CASE WHEN status IN (401, 403) THEN CASE WHEN internal THEN 'medium' ELSE 'low' END WHEN internal THEN 'high' ELSE 'medium' END AS severity FROM t WHERE status IS NULL OR status >= 400""",
)
def link_findings(spark, sf):
    f = N.link_findings(shaped(spark, sf, LINKS), N.effective_probe(shaped(spark, sf, LINK_PROBES)))
    return f.select("title", "url", "occurrences", F.array_join("other_urls", " ").alias("others"), "severity")


@query(
    "duplicate_titles",
    """WITH p AS (SELECT page_id, url, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages),
t AS (SELECT title, count(*) AS n, list(url ORDER BY page_id) AS u FROM p WHERE title <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT n || ' pages share the same <title>: "' || left(title, 60) || '"' AS title, u[1] AS url, n AS occurrences, array_to_string(u[2:8], ' ') AS others FROM t""",
)
def duplicate_titles(spark, sf):
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), F.col("url").alias("page_url"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.lit(200).alias("status")
    )
    return N.duplicate_titles(p).select("title", "url", "occurrences", F.array_join("other_urls", " ").alias("others"))


VIOLATIONS = """SELECT p_partkey AS seq, 'https://shop.example.com/item/' || CAST(p_partkey AS STRING) AS page_url, CASE p_partkey % 4 WHEN 0 THEN 'image-alt' WHEN 1 THEN 'color-contrast' ELSE 'region' END AS rule,
  CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' WHEN 3 THEN 'minor' ELSE NULL END AS impact, 'Elements must ' || p_type AS help, p_size AS total FROM {part}"""


@query(
    "a11y_findings",
    "WITH v AS (" + VIOLATIONS + ") SELECT seq, help AS title, CASE impact WHEN 'critical' THEN 'high' WHEN 'serious' THEN 'medium' WHEN 'moderate' THEN 'low' ELSE 'info' END AS severity, CAST(total AS BIGINT) AS occurrences FROM v WHERE rule <> 'image-alt'",
)
def a11y_findings(spark, sf):
    return N.a11y_findings(shaped(spark, sf, VIOLATIONS)).select("seq", "title", "severity", "occurrences")


# ------------------------------------------------------------------ forms, actions, submissions, controls
FORMS = """SELECT p_partkey AS seq, 'https://shop.example.com/f/' || CAST(p_partkey % 100 AS STRING) AS page_url, '/do/' || CAST(p_partkey % 700 AS STRING) AS signature,
  CASE p_partkey % 7 WHEN 0 THEN '/payment' WHEN 1 THEN '/search' ELSE '/send' END AS action, '' AS id, '' AS name, 'form' AS selector, p_partkey % 2 = 0 AS has_submit, 'Send' AS submit_text,
  p_partkey % 3 = 0 AS novalidate, false AS has_password, p_partkey % 5 = 0 AS req FROM {part}"""


@query(
    "form_findings",
    "WITH f AS (SELECT * FROM (" + FORMS + """) QUALIFY row_number() OVER (PARTITION BY signature ORDER BY seq) = 1),
u AS (SELECT * FROM f WHERE action <> '/payment')
SELECT seq, 'info' AS severity, 'Form not submitted (looks destructive/transactional): Send' AS title FROM f WHERE action = '/payment'
UNION ALL SELECT seq, 'low', 'Form has no submit button' FROM u WHERE NOT has_submit
UNION ALL SELECT seq, 'info', 'Form has novalidate - browser validation is switched off' FROM u WHERE novalidate
UNION ALL SELECT seq, 'medium', 'Form has no required fields at all' FROM u WHERE NOT req AND action <> '/search'""",
)
def form_findings(spark, sf):
    f = shaped(spark, sf, FORMS)
    field = lambda n, req: F.struct(F.lit(n).alias("name"), F.lit("text").alias("type"), req.alias("required"))
    f = f.withColumn("fields", F.array(field("a", F.col("req")), field("b", F.lit(False)))).drop("req")
    return N.form_findings(f).select("seq", "severity", "title")


ACTIONS = "SELECT 'https://u' || CAST(user_id AS STRING) || '.example.com/' AS page_url, event_id * 60000 AS at, event_id AS action_id, value, user_id FROM {events} WHERE event_type = 'click'"
HAPPENINGS = """SELECT 'https://u' || CAST(user_id AS STRING) || '.example.com/' AS page_url, event_id * 60000 AS at, event_id AS seq, user_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'dialog' ELSE 'response' END AS event,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'Clipboard permission denied' ELSE 'boom ' || props END ELSE '' END AS message,
  CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 401 ELSE 200 END AS status,
  CASE WHEN event_type = 'signup' THEN 'alert' WHEN event_id % 3 = 0 THEN 'image' ELSE 'xhr' END AS resource_type,
  'https://api.example.com/' || CASE WHEN event_id % 2 = 0 THEN 'me' ELSE 'data' END AS url FROM {events} WHERE event_type <> 'click'"""
DELTA = "WITH a AS (" + ACTIONS + "), h AS (" + HAPPENINGS + "), d AS (SELECT h.*, a.action_id FROM h ASOF JOIN a ON h.page_url = a.page_url AND h.at >= a.at)"


def happenings(spark, sf):
    h = shaped(spark, sf, HAPPENINGS)
    return h.withColumn("payload", F.struct("message", "url", "status", "resource_type", "seq"))


@query("action_delta", DELTA + " SELECT action_id, event, seq FROM d")
def action_delta(spark, sf):
    d = N.action_delta(shaped(spark, sf, ACTIONS), happenings(spark, sf))
    return d.select("action_id", "event", F.col("payload.seq").alias("seq"))


@query(
    "action_findings",
    DELTA + """, x AS (SELECT a.action_id, value, d.seq, event, message, status, resource_type, url FROM a LEFT JOIN d USING (action_id))
SELECT seq, 'info' AS severity, 'A copy button could not be checked (the test browser has no clipboard)' AS title FROM x WHERE event = 'error' AND seq % 5 = 0
UNION ALL SELECT seq, 'critical', 'Clicking ''Go'' throws: ' || message FROM x WHERE event = 'error' AND seq % 5 <> 0
UNION ALL SELECT seq, 'critical', 'Clicking ''Go'' returns HTTP 500' FROM x WHERE event = 'response' AND status = 500
UNION ALL SELECT seq, 'high', 'Clicking ''Go'' calls a ' || status || ' endpoint' FROM x WHERE event = 'response' AND status IN (401, 404) AND resource_type = 'xhr' AND NOT (status = 401 AND contains(url, '/me'))
UNION ALL SELECT seq, 'low', 'Native browser dialog (alert) opened by ''Go''' FROM x WHERE event = 'dialog'
UNION ALL SELECT action_id, 'low', 'Control appears to do nothing: ''Go''' FROM x GROUP BY action_id, value
  HAVING value <= 12 AND count(*) FILTER (WHERE event IN ('error', 'dialog') OR resource_type = 'xhr') = 0""",
)
def action_findings(spark, sf):
    acts = shaped(spark, sf, ACTIONS)
    state = lambda grow: F.struct(
        F.lit("u").alias("url"), grow.alias("html"), F.lit(0).alias("text"), F.lit(0).alias("dialogs"), F.lit(0).alias("scroll"), F.lit("h").alias("hash"),
        F.lit(0).alias("copies"), F.lit(0).alias("popups"), F.lit(0).alias("downloads"),
    )
    full = acts.select(
        "page_url", "at", "action_id", F.col("action_id").alias("seq"), F.lit("Go").alias("text"), F.lit("button").alias("tag"), F.lit("#go").alias("selector"),
        state(F.lit(0.0)).alias("before"), state(F.col("value")).alias("after"), F.lit(False).alias("restless"),
    )
    return N.action_findings(full, N.action_delta(acts, happenings(spark, sf))).select("seq", "severity", "title")


SUBMISSIONS = """SELECT o_orderkey AS submission_id, o_orderkey AS seq, 'https://shop.example.com/f' AS page_url, 'form' AS selector, CASE o_orderkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'bad_email' ELSE 'valid' END AS mode,
  o_custkey % 2 = 0 AS navigated, o_orderkey % 6 = 0 AS bypassed, CASE WHEN o_orderkey % 4 = 0 THEN false ELSE true END AS valid_before,
  CASE o_custkey % 5 WHEN 0 THEN 'Invalid value' WHEN 1 THEN 'Thank you' ELSE 'Page' END AS body_text, o_orderkey % 5 = 0 AS has_password, o_custkey % 3 = 0 AS still_password, 0 AS dialogs,
  CASE WHEN o_orderkey % 50 = 0 THEN 'boom' END AS js_error, o_orderkey % 40 = 2 AS echoed FROM {orders}"""
SENT = """SELECT o_orderkey AS submission_id, o_orderkey AS seq, 'POST' AS method, 'xhr' AS resource_type, CASE o_custkey % 7 WHEN 0 THEN 500 WHEN 1 THEN 422 ELSE 200 END AS status FROM {orders} WHERE o_custkey % 4 <> 0"""


@query(
    "submission_findings",
    "WITH s AS (" + SUBMISSIONS + "), r AS (" + SENT + """), j AS (SELECT s.*, r.status, r.status IS NOT NULL AS post, coalesce(r.status = 422, false) AS client, coalesce(r.status = 500, false) AS server,
  body_text = 'Invalid value' AS err, body_text = 'Thank you' AS good, CASE mode WHEN 'empty' THEN 'empty submission' WHEN 'bad_email' THEN 'invalid e-mail' ELSE 'valid test data' END AS label FROM s LEFT JOIN r USING (submission_id)),
k AS (SELECT *, navigated OR (post AND NOT err AND NOT client) AS accepted FROM j)
SELECT submission_id AS seq, 'JS' AS kind, 'Submitting the form (' || label || ') throws: boom' AS title FROM k WHERE js_error IS NOT NULL
UNION ALL SELECT submission_id, '5xx', 'Form submission returns HTTP 500 (' || label || ')' FROM k WHERE server
UNION ALL SELECT submission_id, 'g', CASE WHEN mode = 'empty' THEN CASE WHEN bypassed AND accepted THEN 'Server accepts an empty submission (validation is browser-side only)' WHEN bypassed THEN NULL
      WHEN NOT valid_before AND NOT navigated AND NOT post THEN NULL WHEN accepted THEN 'Form accepts a completely empty submission'
      WHEN NOT err AND NOT navigated AND NOT post AND valid_before THEN 'Empty submission is silently ignored' END
    WHEN mode = 'bad_email' THEN CASE WHEN accepted THEN 'Form accepts an invalid e-mail address' END
    WHEN has_password THEN CASE WHEN NOT err AND NOT still_password AND navigated THEN 'Credentials form accepted made-up login details' WHEN NOT err AND NOT navigated AND NOT post THEN 'Login form gives no feedback for wrong credentials' END
    ELSE CASE WHEN NOT navigated AND NOT post AND NOT err AND NOT good THEN 'Form does nothing when submitted with valid data' WHEN err AND NOT client AND NOT server THEN 'Valid test data produces an error message' END END AS title
  FROM k WHERE title IS NOT NULL
UNION ALL SELECT submission_id, '4xx', 'Form submission returns HTTP 422' FROM k WHERE client AND mode = 'valid' AND NOT has_password
UNION ALL SELECT submission_id, 'echo', 'User input is rendered as raw HTML (output not escaped)' FROM k WHERE echoed AND mode = 'valid'""",
)
def submission_findings(spark, sf):
    f = N.submission_findings(shaped(spark, sf, SUBMISSIONS), shaped(spark, sf, SENT))
    t = F.col("title")
    kind = F.when(t.startswith("Submitting"), "JS").when(t.contains("HTTP 500"), "5xx").when(t.contains("HTTP 422"), "4xx").when(t.startswith("User input"), "echo").otherwise("g")
    return f.select("seq", kind.alias("kind"), "title")


CLICKABLES = """SELECT p_partkey AS seq, 'https://shop.example.com/' AS page_url, CASE WHEN p_partkey % 2 = 0 THEN 'button' ELSE 'div' END AS tag, '#c' || CAST(p_partkey % 300 AS STRING) AS selector,
  CASE p_partkey % 3 WHEN 0 THEN 'Delete ' || p_name WHEN 1 THEN '' ELSE p_name END AS text, CASE p_partkey % 3 WHEN 1 THEN '<i>logout</i>' ELSE '' END AS html, p_partkey % 11 = 0 AS disabled, p_partkey % 5 = 0 AS in_form, '' AS type FROM {part}"""


@query(
    "skipped_controls",
    "WITH c AS (SELECT * FROM (" + CLICKABLES + """) QUALIFY row_number() OVER (PARTITION BY tag, selector, left(text, 40) ORDER BY seq) = 1)
SELECT seq, 'Destructive-looking control not clicked: ''' || CASE WHEN text <> '' THEN text ELSE tag END || '''' AS title FROM c WHERE NOT disabled AND NOT (in_form AND tag = 'button') AND seq % 3 <> 2""",
)
def skipped_controls(spark, sf):
    return N.skipped_controls(shaped(spark, sf, CLICKABLES)).select("seq", "title")


@query(
    "probe_verdicts",
    "WITH p AS (" + PROBES + """) SELECT seq, CASE WHEN status IS NULL THEN 'unreachable' WHEN status IN (404, 410) THEN 'missing' WHEN status < 400 THEN 'present' ELSE 'blocked' END AS verdict,
content_type LIKE '%text/html%' OR ltrim(lower(body)) LIKE '<!doctype html%' AS html FROM p""",
)
def probe_verdicts(spark, sf):
    return probes(spark, sf).select("seq", P.verdict(F.col("status")).alias("verdict"), P.is_html(F.col("content_type"), F.col("body")).alias("html"))


# ------------------------------------------------------------------ robots, sitemaps, offline
ROBOTS = """SELECT 'https://c' || CAST(c_custkey AS STRING) || '.example.com' AS origin, CASE WHEN c_custkey % 9 = 0 THEN 404 ELSE 200 END AS status,
  'User-agent: *' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'Disallow: /item/1' WHEN 1 THEN 'Allow: /item/12' || chr(10) || 'Disallow: /item/1' ELSE 'Disallow:' END || chr(10) || 'Crawl-delay: 2' || chr(10) || chr(10) ||
  CASE WHEN c_custkey % 5 = 0 THEN 'User-agent: LoomIndex' || chr(10) || 'Disallow: /' || chr(10) || 'Crawl-delay: 7' || chr(10) ELSE '' END || 'Sitemap: https://maps.example.com/' || CAST(c_custkey AS STRING) || '.xml' AS body FROM {customer}"""
VISITS = "SELECT DISTINCT 'https://c' || CAST(o_custkey AS STRING) || '.example.com/item/' || CAST(o_orderkey % 30 AS STRING) AS url, o_custkey AS k, o_orderkey % 30 AS i FROM {orders}"


@query(
    "robots_allowed",
    "WITH v AS (" + VISITS + """) SELECT url, CASE WHEN k % 9 = 0 THEN true WHEN k % 3 = 0 THEN NOT CAST(i AS STRING) LIKE '1%' WHEN k % 3 = 1 THEN CAST(i AS STRING) LIKE '12%' OR NOT CAST(i AS STRING) LIKE '1%' ELSE true END AS allowed,
CASE WHEN k % 9 = 0 THEN 0.0 WHEN k % 5 = 0 THEN 7.0 ELSE 2.0 END::DOUBLE AS crawl_delay FROM v""",
)
def robots_allowed(spark, sf):
    return C.robots_allowed(shaped(spark, sf, VISITS), shaped(spark, sf, ROBOTS), "LoomIndex/2.0")


@query("sitemap_refs", "SELECT 'https://c' || c_custkey || '.example.com' AS origin, 'https://maps.example.com/' || c_custkey || '.xml' AS refs FROM customer")
def sitemap_refs(spark, sf):
    r = shaped(spark, sf, ROBOTS)
    return r.select("origin", F.array_join(C.sitemap_refs(F.col("body"), F.col("origin")), " ").alias("refs"))


MAPS = """SELECT 'https://s' || CAST(o_custkey AS STRING) || '.example.com' AS site, 'https://s' || CAST(o_custkey AS STRING) || '.example.com/map' || CAST(o_orderkey AS STRING) || '.xml' AS url, o_orderkey AS seq, 200 AS status,
  '<urlset><url><loc> https://s' || CAST(o_custkey AS STRING) || '.example.com/p/' || CAST(o_orderkey % 4 AS STRING) || '/ </loc></url><url><LOC>https://else.example.net/x</LOC></url><url><loc>https://s' ||
  CAST(o_custkey AS STRING) || '.example.com/sub' || CAST(o_custkey AS STRING) || '.xml</loc></url></urlset>' AS body FROM {orders}"""
SUBMAPS = """SELECT 'https://s' || CAST(c_custkey AS STRING) || '.example.com' AS site, 'https://s' || CAST(c_custkey AS STRING) || '.example.com/sub' || CAST(c_custkey AS STRING) || '.xml' AS url, CAST(NULL AS BIGINT) AS seq, 200 AS status,
  '<urlset><url><loc>https://s' || CAST(c_custkey AS STRING) || '.example.com/deep</loc></url></urlset>' AS body FROM {customer}"""


@query(
    "sitemap_urls",
    """SELECT DISTINCT 'https://s' || o_custkey || '.example.com' AS site, 'https://s' || o_custkey || '.example.com/p/' || (o_orderkey % 4) AS url FROM orders
UNION SELECT 'https://s' || o_custkey || '.example.com', 'https://s' || o_custkey || '.example.com/deep' FROM orders""",
)
def sitemap_urls(spark, sf):
    fetches = shaped(spark, sf, MAPS).unionByName(shaped(spark, sf, SUBMAPS))
    return C.sitemap_urls(fetches).select("site", "url")


CRAWLS = "SELECT user_id AS run, event_id AS seq, event_type <> 'purchase' AS failed, CASE WHEN event_type IN ('error', 'signup', 'view') THEN 'net::ERR_NAME_NOT_RESOLVED at x' ELSE 'net::ERR_TIMED_OUT' END AS error FROM {events}"


@query(
    "offline_stops",
    "WITH c AS (SELECT run, seq, failed AND contains(error, 'NAME_NOT') AS off, row_number() OVER (PARTITION BY run ORDER BY seq) AS n FROM (" + CRAWLS + """)),
g AS (SELECT run, seq, row_number() OVER (PARTITION BY run, n - k ORDER BY seq) AS len FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS k FROM c WHERE off))
SELECT run, min(seq) AS stop_seq FROM g WHERE len = 3 GROUP BY 1""",
)
def offline_stops(spark, sf):
    return C.offline_stops(shaped(spark, sf, CRAWLS))
