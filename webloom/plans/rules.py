"""Queries on page rules: the given pages, and a shop with one page per part whose
defects follow from the part's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import rules as R
from webloom.plans.registry import query, shaped, table
from webloom.plans.text import DUCK_PLAIN
from webloom.sources.pages import spread

SHOP = """SELECT p_partkey AS page_id, 'https://shop.example.com/item/' || CAST(p_partkey AS STRING) AS url, p_partkey % 50 = 0 AS is_entry,
CASE WHEN p_partkey % 97 = 0 THEN '<html><body><p>tiny</p></body></html>' ELSE
 '<!DOCTYPE html><html' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' lang="en"' END || '><head><meta charset="utf-8">' ||
 CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '<title>A very long title that goes on and on for no good reason at all &amp; more ' || p_name || '</title>'
   ELSE '<title>' || p_name || ' ' || CAST(p_partkey % 40 AS STRING) || '</title>' END ||
 CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '<META NAME="Description" content=" ">' ELSE '<meta name=description content="About it">' END ||
 CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '<meta name="viewport" content="width=device-width, user-scalable=no">'
   WHEN 2 THEN '<meta name="viewport" content="maximum-scale=1.0">' WHEN 3 THEN '<meta name="viewport" content="maximum-scale=10">'
   ELSE '<meta name="viewport" content="width=device-width">' END ||
 CASE WHEN p_partkey % 11 = 0 THEN '<meta name="ROBOTS" content="NoIndex, follow">' ELSE '' END ||
 CASE WHEN p_partkey % 100 = 0 THEN '<link rel="shortcut icon" href="/i.ico">' ELSE '' END ||
 CASE WHEN p_partkey % 150 = 0 THEN '<meta property="og:title" content="t">' ELSE '' END || '</head><body><!-- <h1>not me</h1> -->' ||
 CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '<h1>One</h1><h1>Two</h1>' ELSE '<h1>One</h1>' END ||
 '<h2>Part</h2>' || CASE WHEN p_partkey % 8 = 0 THEN '<h4>Deep</h4>' ELSE '<h3>Fine</h3>' END ||
 '<p>This page tells about the part named ' || p_name || ' in some detail.</p><script>var x = "<img src=no>";</script>' ||
 CASE p_partkey % 4 WHEN 1 THEN '<img src="/img/a.png">' WHEN 2 THEN '<img id="pic" src="/img/b.png"><img src="/img/c.png"><img src="/d.png" alt="">' ELSE '' END ||
 CASE p_partkey % 5 WHEN 2 THEN '<a href="/x"> <i></i></a>' WHEN 3 THEN '<a href="/x"><img src="i.png" alt="pic"></a>'
   WHEN 4 THEN '<span aria-hidden="true"><a href="/y"></a></span>' ELSE '<a href="/x">go</a>' END ||
 CASE WHEN p_partkey % 6 = 5 THEN '<a href="/z" target="_blank">z</a><a href="/z" target="_blank" rel="NoOpener">z</a>' ELSE '' END ||
 CASE WHEN p_partkey % 9 = 0 THEN '<a name="k">k</a>' ELSE '' END ||
 CASE p_partkey % 10 WHEN 0 THEN '<form action="http://pay.example.com/x"><label for="nope">Name</label><input name="n"></form>'
   WHEN 1 THEN '<form action="/s"><input name="q"><input name="r" placeholder="type"><input type="hidden" name="h"></form>'
   WHEN 2 THEN '<form action="/s" method="POST"><label for="e">E-mail (optional)</label><input id="e" type="email" required><button>Send</button></form>'
   WHEN 3 THEN '<label>Phone <input type="tel" autocomplete="tel"></label>'
   WHEN 4 THEN '<button></button><button aria-label="x"></button><div role="button"></div><input type="submit"><input type="submit" value="Go">'
   WHEN 5 THEN '<div onclick="go()">Menu</div><div onclick="go()"><a href="/w">w</a></div><div onclick="go()" tabindex="0">ok</div>'
   WHEN 6 THEN '<a href="mailto:A@example.com?subject=x">b@example.com</a><a href="tel:+1-555-000-1111">555 000 1112</a><a href="mailto:c@example.com">C@example.com</a>'
   WHEN 7 THEN '<p id="d">x</p><p id="d">y</p><p id="d">y</p><p id="u">z</p>'
   WHEN 8 THEN '<iframe src="/f"></iframe><video autoplay src="/v"></video><video autoplay muted><track kind="captions"></video><img src="http://cdn.example.com/i.png" alt="i">'
   ELSE '<p>Lorem ipsum dolor</p>' END || '</body></html>' END AS html FROM {part}"""

# what each part's page must be found guilty of
GUILTY = """p AS (SELECT p_partkey AS k, p_name, p_partkey % 97 = 0 AS tiny, 'https://shop.example.com/item/' || p_partkey AS url FROM part),
g AS (SELECT k, url, 'high' AS severity, 'Content' AS category, 'Page renders (almost) no text' AS title, 1 AS occurrences FROM p WHERE tiny
UNION ALL SELECT k, url, 'medium', 'SEO', 'Page has no <title>', 1 FROM p WHERE tiny OR k % 5 = 0
UNION ALL SELECT k, url, 'info', 'SEO', 'Page title is longer than 65 characters', 1 FROM p WHERE NOT tiny AND k % 5 = 1
UNION ALL SELECT k, url, 'low', 'SEO', 'No meta description', 1 FROM p WHERE tiny OR k % 4 = 0
UNION ALL SELECT k, url, 'low', 'SEO', 'Meta description is empty', 1 FROM p WHERE NOT tiny AND k % 4 = 1
UNION ALL SELECT k, url, 'low', 'SEO', 'Page has no <h1>', 1 FROM p WHERE tiny OR k % 7 = 0
UNION ALL SELECT k, url, 'info', 'SEO', 'Page has 2 <h1> headings', 1 FROM p WHERE NOT tiny AND k % 7 = 1
UNION ALL SELECT k, url, 'info', 'SEO', 'No favicon declared', 1 FROM p WHERE k % 50 = 0 AND (tiny OR k % 100 <> 0)
UNION ALL SELECT k, url, 'medium', 'SEO', 'Page is marked noindex', 1 FROM p WHERE NOT tiny AND k % 11 = 0
UNION ALL SELECT k, url, 'info', 'SEO', 'No Open Graph tags', 1 FROM p WHERE k % 50 = 0 AND (tiny OR k % 150 <> 0)
UNION ALL SELECT k, url, 'low', 'Accessibility', '<html> has no lang attribute', 1 FROM p WHERE tiny OR k % 3 = 0
UNION ALL SELECT k, url, 'high', 'Responsive', 'No responsive viewport meta tag', 1 FROM p WHERE tiny OR k % 6 = 0
UNION ALL SELECT k, url, 'low', 'Accessibility', 'Viewport meta disables pinch zoom', 1 FROM p WHERE NOT tiny AND k % 6 IN (1, 2)
UNION ALL SELECT k, url, 'medium', 'Accessibility', 'Images without an alt attribute', k % 4 FROM p WHERE NOT tiny AND k % 4 IN (1, 2)
UNION ALL SELECT k, url, 'medium', 'Accessibility', 'Links with no readable text', 1 FROM p WHERE NOT tiny AND k % 5 = 2
UNION ALL SELECT k, url, 'low', 'Security', 'Links open a new tab without rel=noopener', 1 FROM p WHERE NOT tiny AND k % 6 = 5
UNION ALL SELECT k, url, 'info', 'Accessibility', '<a> elements without an href', 1 FROM p WHERE NOT tiny AND k % 9 = 0
UNION ALL SELECT k, url, 'medium', 'Accessibility', 'Label is not connected to its field', 1 FROM p WHERE NOT tiny AND k % 10 = 0
UNION ALL SELECT k, url, 'critical', 'Security', 'Form submits over plain HTTP', 1 FROM p WHERE NOT tiny AND k % 10 = 0
UNION ALL SELECT k, url, 'medium', 'Accessibility', 'Form fields with no label', 1 FROM p WHERE NOT tiny AND k % 10 = 1
UNION ALL SELECT k, url, 'low', 'Accessibility', 'Fields rely on placeholder text instead of a label', 1 FROM p WHERE NOT tiny AND k % 10 = 1
UNION ALL SELECT k, url, 'medium', 'Forms', 'Field says optional but the form requires it: ''E-mail (optional)''', 1 FROM p WHERE NOT tiny AND k % 10 = 2
UNION ALL SELECT k, url, 'low', 'Forms', 'Personal-data fields give no autocomplete hint', 1 FROM p WHERE NOT tiny AND k % 10 = 2
UNION ALL SELECT k, url, 'medium', 'Accessibility', 'Buttons with no accessible name', 3 FROM p WHERE NOT tiny AND k % 10 = 4
UNION ALL SELECT k, url, 'medium', 'Accessibility', 'Clickable items a keyboard cannot reach', 1 FROM p WHERE NOT tiny AND k % 10 = 5
UNION ALL SELECT k, url, 'medium', 'Content', 'Contact link opens a different e-mail address than it shows', 1 FROM p WHERE NOT tiny AND k % 10 = 6
UNION ALL SELECT k, url, 'medium', 'Content', 'Contact link opens a different phone number than it shows', 1 FROM p WHERE NOT tiny AND k % 10 = 6
UNION ALL SELECT k, url, 'low', 'HTML Validity', 'Duplicate element ids', 1 FROM p WHERE NOT tiny AND k % 10 = 7
UNION ALL SELECT k, url, 'info', 'Accessibility', 'iframe without a title attribute', 1 FROM p WHERE NOT tiny AND k % 10 = 8
UNION ALL SELECT k, url, 'low', 'UX', 'Media auto-plays with sound', 1 FROM p WHERE NOT tiny AND k % 10 = 8
UNION ALL SELECT k, url, 'low', 'Accessibility', 'Videos without captions', 1 FROM p WHERE NOT tiny AND k % 10 = 8
UNION ALL SELECT k, url, 'high', 'Security', 'Mixed content (http:// resources on an https:// page)', 1 FROM p WHERE NOT tiny AND k % 10 = 8
UNION ALL SELECT k, url, 'medium', 'Content', 'Placeholder / debug text visible to users: lorem ipsum', 1 FROM p WHERE NOT tiny AND k % 10 = 9
UNION ALL SELECT k, url, 'info', 'Accessibility', 'Heading levels are skipped', 1 FROM p WHERE NOT tiny AND k % 8 = 0)"""


def shop(spark, sf):
    return spread(shaped(spark, sf, SHOP))


def shop_findings(spark, sf):
    return R.page_findings(shop(spark, sf))


@query("page_rules", "WITH " + GUILTY + " SELECT url, severity, category, title, occurrences FROM g")
def page_rules(spark, sf):
    return shop_findings(spark, sf).select("url", "severity", "category", "title", "occurrences")


@query(
    "page_rules_given_pages",
    f"""WITH t AS (SELECT url, html, {DUCK_PLAIN} AS text, replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&') AS title FROM pages),
j AS (SELECT * FROM (VALUES ('lorem ipsum', '(?i)lorem ipsum', 'medium'), ('undefined', '(^|[\\s>|:,])undefined([\\s<|.,!]|$)', 'high'),
  ('NaN', '(^|[\\s>|:,])NaN([\\s<|.,!]|$)', 'high'), ('[object Object]', '\\[object Object\\]', 'high'), ('TODO/FIXME', '\\b(TODO|FIXME|XXX):', 'medium'),
  ('null value shown', '(^|[\\s>|:,])null([\\s<|.,!]|$)', 'medium'), ('template placeholder', '\\{{\\{{\\s*[\\w.$]+\\s*\\}}\\}}|%[A-Z_]{{3,}}%', 'medium'),
  ('Error text', '\\b(Exception|Stack trace|Fatal error|Warning: |Notice: |Traceback \\(most recent)', 'high'),
  ('test placeholder', '(?i)\\b(test test|asdf|qwerty|placeholder text|coming soon)\\b', 'medium')) AS v(label, rx, sev))
SELECT url, 'low' AS severity, 'No meta description' AS title FROM t UNION ALL SELECT url, 'high', 'No responsive viewport meta tag' FROM t
UNION ALL SELECT url, 'info', 'Page title is longer than 65 characters' FROM t WHERE length(trim(title)) > 65
UNION ALL SELECT url, 'medium', 'Page has no <title>' FROM t WHERE trim(title) = ''
UNION ALL SELECT url, 'high', 'Page renders (almost) no text' FROM t WHERE length(text) < 30
UNION ALL SELECT url, sev, 'Placeholder / debug text visible to users: ' || label FROM t, j WHERE regexp_matches(text, rx)""",
)
def page_rules_given_pages(spark, sf):
    return R.page_findings(spread(table(spark, sf, "pages"))).select("url", "severity", "title")


@query(
    "page_facts",
    """SELECT p_partkey AS page_id, p_partkey % 97 <> 0 AND p_partkey % 150 = 0 AS og_title, p_partkey % 97 <> 0 AND p_partkey % 100 = 0 AS favicon,
CASE WHEN p_partkey % 97 <> 0 THEN 'utf-8' END AS charset, CASE WHEN p_partkey % 97 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 = 1 THEN 2 ELSE 1 END AS h1,
CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END + CAST(p_partkey % 5 = 3 AS INT) + CAST(p_partkey % 10 = 8 AS INT) END AS images,
0 AS inline_styles FROM part""",
)
def page_facts(spark, sf):
    return R.page_facts(shop(spark, sf)).select("page_id", "og_title", "favicon", "charset", "h1", F.size("images").alias("images"), "inline_styles")


@query(
    "form_facts",
    """SELECT p_partkey AS page_id, CASE p_partkey % 10 WHEN 0 THEN 'http://pay.example.com/x::input:n' WHEN 1 THEN '/s::input:q,input:r,hidden:h' ELSE '/s::email:' END AS signature,
CASE WHEN p_partkey % 10 = 2 THEN 'post' ELSE 'get' END AS method, p_partkey % 10 = 2 AS has_submit, CASE WHEN p_partkey % 10 = 2 THEN 'Send' ELSE '' END AS submit_text, false AS has_password
FROM part WHERE p_partkey % 97 <> 0 AND p_partkey % 10 IN (0, 1, 2)""",
)
def form_facts(spark, sf):
    return R.form_facts(R.page_facts(shop(spark, sf))).select("page_id", "signature", "method", "has_submit", "submit_text", "has_password")


IMAGE_ANSWERS = """SELECT 'https://shop.example.com/item/' || CAST(p_partkey AS STRING) AS page_url,
  'https://shop.example.com/img/' || CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'a' END || '.png' AS url,
  CASE WHEN p_size % 3 = 0 THEN 404 ELSE 200 END AS status FROM {part}"""


@query(
    "broken_images",
    """SELECT 'https://shop.example.com/item/' || p_partkey AS url, 1 AS occurrences, CASE WHEN p_partkey % 4 = 2 THEN '#pic' ELSE 'img' END AS element FROM part
WHERE p_partkey % 97 <> 0 AND p_size % 3 = 0 AND ((p_partkey % 4 = 1 AND p_size % 2 = 1) OR (p_partkey % 4 = 2 AND p_size % 2 = 0))""",
)
def broken_images(spark, sf):
    return R.broken_images(R.page_facts(shop(spark, sf)), shaped(spark, sf, IMAGE_ANSWERS)).select("url", "occurrences", "element")


@query(
    "server_rendering",
    """SELECT 'https://shop.example.com/item/' || p_partkey AS url, 'Page content only appears after JavaScript runs' AS title FROM part
WHERE p_partkey % 50 = 0 AND p_size * 50 >= 600""",
)
def server_rendering(spark, sf):
    pages = shaped(
        spark, sf,
        "SELECT p_partkey AS page_id, 'https://shop.example.com/item/' || CAST(p_partkey AS STRING) AS url, p_partkey % 50 = 0 AS is_entry, "
        "'<html><body><div id=root>' || p_name || '</div></body></html>' AS html, p_size * 50 AS rendered_chars FROM {part}",
    )
    return R.page_findings(pages).where("title LIKE 'Page content only%'").select("url", "title")


# a page that names no language is judged from 30 words on: all with contact links have them, and three with a form
JUDGED = "p_partkey % 97 <> 0 AND (p_partkey % 3 <> 0 OR p_partkey % 10 = 6 OR (p_partkey % 10 = 2 AND p_partkey % 7 = 1 AND p_partkey % 9 = 0))"


@query(
    "spelling_findings",
    f"""SELECT 'https://shop.example.com/item/' || p_partkey AS url, 'Spelling mistake: ''detail'' should be ''detailed account''' AS title FROM part
WHERE {JUDGED}
UNION ALL SELECT 'https://shop.example.com/item/' || p_partkey, 'Spelling mistake: ''Part'' should be ''Piece''' FROM part WHERE {JUDGED}""",
)
def spelling_findings(spark, sf):
    book = shaped(spark, sf, "SELECT DISTINCT 'detail' AS wrong, 'detailed account' AS right FROM {region} UNION SELECT 'part', 'piece' FROM {region}")
    return R.spelling_findings(R.page_facts(shop(spark, sf)), book).select("url", "title")


@query(
    "spelling_evidence",
    f"""SELECT 'https://shop.example.com/item/' || p_partkey AS url, 'detail' AS word, 'detailed account' AS suggestion, '1' AS times,
  'ls about the part named ' || p_name || ' in some detail.' AS near FROM part WHERE {JUDGED}""",
)
def spelling_evidence(spark, sf):
    """The evidence of each slip, of its context the words before it."""
    book = shaped(spark, sf, "SELECT DISTINCT 'detail' AS wrong, 'detailed account' AS right FROM {region}")
    e = R.spelling_findings(R.page_facts(shop(spark, sf)), book)
    shown = [F.col("evidence")[k].alias(k) for k in ("word", "suggestion", "times")]
    return e.select("url", *shown, F.regexp_extract(F.col("evidence")["context"], "(ls about the part named .* in some detail\\.)", 1).alias("near"))
