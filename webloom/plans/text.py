"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import html as H
from webloom.functions import text as X
from webloom.operators import spelling as S
from webloom.operators import topics as T
from webloom.plans.registry import query, shaped, table
from webloom.sources.pages import spread

WORD_RX = "\\p{L}+(?:[''’]\\p{L}+)*"
STOP = "(" + ", ".join(f"'{w}'" for w in seeds.ENGLISH_STOP_WORDS) + ")"
TERMS = ["the", "tion", "in", "ation", "hand", "oner re", "zzz"]


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(
    "doc_words",
    f"""SELECT doc_id, len(ws) AS words, array_to_string(list_sort(list_distinct(list_filter(ws, lambda w: contains(w, chr(39))))), ',') AS quoted
FROM (SELECT doc_id, regexp_extract_all(text, '{WORD_RX}') AS ws FROM documents)""",
)
def doc_words(spark, sf):
    w = X.words(F.col("text"))
    marked = F.array_sort(F.array_distinct(F.filter(w, lambda x: x.contains("'"))))
    return docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("words"), F.array_join(marked, ",").alias("quoted"))


@query(
    "english_gate",
    f"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '{WORD_RX}') AS ws FROM documents)
SELECT doc_id, lang LIKE 'en%' AS declared, len(ws) >= 30 AND len(list_filter(ws, lambda x: lower(x) IN {STOP}))::DOUBLE / greatest(len(ws), 1) > 0.05 AS judged FROM w""",
)
def english_gate(spark, sf):
    w = X.words(F.col("text"))
    return docs(spark, sf).select(
        "doc_id", X.looks_english(F.col("lang"), w).alias("declared"), X.looks_english(F.lit(None), w).alias("judged")
    )


# the dictionary of the check queries: words that do stand in the texts
BOOK_WORDS = """SELECT * FROM (VALUES ('ther', 'there'), ('onthe', 'on the'), ('andthe', 'and the'), ('inger', 'finger'), ('atre', 'theatre'),
  ('reha', 'rehab'), ('thersh', 'thrash'), ('ered', 'erred')) AS b(wrong, correct)"""

#: a declared language decides, else 30 words and over 5 % stop words
ENGLISH = (
    f"(lower(trim(coalesce(lang, ''))) LIKE 'en%' OR (trim(coalesce(lang, '')) = '' AND len(ws) >= 30 AND "
    f"len(list_filter(ws, lambda x: lower(x) IN {STOP}))::DOUBLE / greatest(len(ws), 1) > 0.05))"
)

HITS = f"""WITH book AS ({BOOK_WORDS}), w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD_RX}') AS ws, lang FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w WHERE {ENGLISH} AND len(ws) > 0),
h AS (SELECT doc_id, wrong AS low, count(*) AS times, arg_min(word, pos) AS shown, any_value(correct) AS fix FROM e JOIN book ON lower(word) = wrong GROUP BY 1, 2),
s AS (SELECT doc_id, low, times, shown, CASE WHEN shown = upper(shown) AND length(shown) > 1 THEN upper(fix)
  WHEN substr(shown, 1, 1) = upper(substr(shown, 1, 1)) THEN upper(substr(fix, 1, 1)) || substr(fix, 2) ELSE fix END AS suggestion FROM h)"""


@query("misspellings", HITS + " SELECT doc_id, low, shown, suggestion, times FROM s")
def misspellings(spark, sf):
    eng = S.english(docs(spark, sf))
    return S.misspellings(eng, shaped(spark, sf, BOOK_WORDS).withColumnRenamed("correct", "right")).select("doc_id", "low", "shown", "suggestion", "times")


@query(
    "misspelling_context",
    HITS + """, m AS (SELECT s.doc_id, low, shown, text, length(regexp_extract(text, '(?is)^(.*?)(?:^|[^\\p{L}])' || shown || '(?:[^\\p{L}]|$)', 1)) AS b,
  regexp_matches(text, '(?i)^' || shown || '(?:[^\\p{L}]|$)') AS at_start FROM s JOIN documents USING (doc_id)),
p AS (SELECT doc_id, low, text, length(shown) AS n, CASE WHEN at_start THEN 0 ELSE b + 1 END AS i FROM m),
c AS (SELECT doc_id, low, text, greatest(i - 50, 0) AS a, least(length(text), i + n + 50) AS z FROM p)
SELECT doc_id, low, CASE WHEN a > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)), '\\s+', ' ', 'g'))
  || CASE WHEN z < length(text) THEN '…' ELSE '' END AS context FROM c""",
)
def misspelling_context(spark, sf):
    eng = S.english(docs(spark, sf))
    return S.misspellings(eng, shaped(spark, sf, BOOK_WORDS).withColumnRenamed("correct", "right")).select("doc_id", "low", "context")


# review texts shaped from orders, with slips in known places
NOTES = """SELECT o_orderkey AS doc_id, 'en' AS lang,
  'Order ' || CAST(o_orderkey AS STRING) || '. ' ||
  CASE o_orderkey % 5 WHEN 0 THEN 'It could of come sooner. ' WHEN 1 THEN 'Yes, would of course do. ' WHEN 2 THEN 'You Should  of called. ' ELSE '' END ||
  CASE o_orderkey % 3 WHEN 0 THEN 'Thanks - your welcome! ' WHEN 1 THEN 'See your welcome page. ' ELSE '' END ||
  CASE o_orderkey % 4 WHEN 0 THEN 'The committment and the commitment. ' WHEN 1 THEN 'We planned and planed. ' WHEN 2 THEN 'Embarrassed, embarassed, embarassed. ' ELSE '' END AS text,
  CASE o_orderkey % 7 WHEN 0 THEN 'Forget your  password?' WHEN 1 THEN 'forget password' WHEN 2 THEN 'Forget it' ELSE 'Home' END AS button
FROM {orders}"""


def notes(spark, sf):
    return shaped(spark, sf, NOTES).withColumn("ui", F.array("button"))


PHRASES = """n AS (SELECT doc_id, doc_id % 5 AS a, doc_id % 3 AS b, doc_id % 4 AS c, doc_id % 7 AS d FROM (""" + NOTES + """)),
ph AS (SELECT doc_id, 1 AS n, CASE d WHEN 0 THEN 'Forget your password?' ELSE 'forget password' END AS shown,
    CASE d WHEN 0 THEN 'Forgot your password?' ELSE 'forgot password' END AS suggestion FROM n WHERE d IN (0, 1)
  UNION ALL SELECT doc_id, 2, CASE a WHEN 0 THEN 'could of' ELSE 'Should  of' END, CASE a WHEN 0 THEN 'could have' ELSE 'Should have' END FROM n WHERE a IN (0, 2)
  UNION ALL SELECT doc_id, 3, 'your welcome', 'you''re welcome' FROM n WHERE b = 0)"""


@query("wrong_phrases", "WITH " + PHRASES + " SELECT * FROM ph")
def wrong_phrases(spark, sf):
    return S.wrong_phrases(S.english(notes(spark, sf)))


VARIANTS = """va AS (SELECT doc_id, 'commitment' AS rare, 'committment' AS common, 1 AS rare_times, 1 AS common_times FROM n WHERE c = 0
  UNION ALL SELECT doc_id, 'Embarrassed', 'embarassed', 1, 2 FROM n WHERE c = 2)"""


@query("spelling_variants", "WITH " + PHRASES + ", " + VARIANTS + " SELECT * FROM va")
def spelling_variants(spark, sf):
    return S.spelling_variants(S.english(notes(spark, sf))).select("doc_id", "rare", "common", "rare_times", "common_times")


@query(
    "spelling_variants_documents",
    f"""WITH w AS (SELECT doc_id, lower(unnest(ws)) AS low FROM (SELECT doc_id, lang, regexp_extract_all(text, '{WORD_RX}') AS ws FROM documents) WHERE {ENGLISH}),
c AS (SELECT doc_id, low, count(*) AS n FROM w GROUP BY 1, 2),
d AS (SELECT doc_id, low, n, unnest(generate_series(1, length(low) - 1)) AS i FROM c WHERE regexp_full_match(low, '[a-z]{{7,}}')),
g AS (SELECT doc_id, low, n, left(low, i) || substr(low, i + 2) AS single FROM d WHERE substr(low, i, 1) = substr(low, i + 1, 1)
  AND substr(low, i + 2) NOT IN ({', '.join(f"'{x}'" for x in seeds.DOUBLING_SUFFIXES)}))
SELECT DISTINCT g.doc_id, CASE WHEN c.n <= g.n THEN g.single ELSE g.low END AS rare, CASE WHEN c.n <= g.n THEN g.low ELSE g.single END AS common,
  least(c.n, g.n) AS rare_times, greatest(c.n, g.n) AS common_times FROM g JOIN c ON c.doc_id = g.doc_id AND c.low = g.single""",
)
def spelling_variants_documents(spark, sf):
    v = S.spelling_variants(S.english(docs(spark, sf)))
    return v.select("doc_id", F.lower("rare").alias("rare"), F.lower("common").alias("common"), "rare_times", "common_times")


@query(
    "text_findings",
    "WITH " + PHRASES + ", " + VARIANTS + """, f AS (
  SELECT doc_id, 1 AS o, 0 AS p, 'Spelling mistake: ''Order'' should be ''Ordinance''' AS title FROM n
  UNION ALL SELECT doc_id, 2, n, 'Wrong phrase: ''' || shown || ''' should be ''' || suggestion || '''' FROM ph
  UNION ALL SELECT doc_id, 3, 0, 'Same word spelled two ways: ''' || rare || ''' and ''' || common || '''' FROM va)
SELECT doc_id, place, title FROM (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY o, p) AS place FROM f)""",
)
def text_findings(spark, sf):
    book = shaped(spark, sf, "SELECT DISTINCT 'order' AS wrong, 'ordinance' AS right FROM {region}")
    return S.text_findings(notes(spark, sf), book).select("doc_id", "place", "title")


# ------------------------------------------------------------------ topics
NORM = "regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')"
FOUND = f"""WITH t AS (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term), f AS (SELECT doc_id, term FROM documents, t WHERE contains({NORM}, term)),
h AS (SELECT doc_id, term FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.term <> f.term AND contains(f.term, g.term)))"""


@query("topic_hits", FOUND + " SELECT * FROM h")
def topic_hits(spark, sf):
    return T.topic_hits(docs(spark, sf), TERMS)


@query("topic_hits_joined", FOUND + " SELECT * FROM h")
def topic_hits_joined(spark, sf):
    """Terms from a table: the same rows."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return T.topic_hits(docs(spark, sf), terms)


@query(
    "topic_hits_names",
    f"""WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(substr(w, 1, 5)), '[^a-z0-9]+', ' ', 'g')) AS term FROM (
    SELECT unnest(string_split(p_name || ' ' || p_brand || ' ' || coalesce(text, ''), ' ')) AS w FROM part LEFT JOIN benchmark ON item_id = p_partkey) WHERE length(w) > 5),
few AS (SELECT term FROM t WHERE term <> '' AND NOT EXISTS (FROM t AS o WHERE o.term <> '' AND o.term <> t.term AND contains(t.term, o.term))),
hay AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g') AS hay FROM documents)
SELECT doc_id, term FROM hay JOIN few ON contains(hay, term)""",
)
def topic_hits_names(spark, sf):
    """A long list: the first letters of all long words of the benchmark's texts and the parts' names."""
    words = table(spark, sf, "part").join(table(spark, sf, "benchmark"), F.col("item_id") == F.col("p_partkey"), "left")
    words = words.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", F.coalesce("text", F.lit(""))), " ")).alias("w"))
    return T.topic_hits(docs(spark, sf), words.where(F.length("w") > 5).select(F.substring("w", 1, 5).alias("term")))


@query(
    "topic_match",
    FOUND + " SELECT d.doc_id, count(term) AS hits, count(term) >= 2 AS on_topic FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY 1",
)
def topic_match(spark, sf):
    return T.topic_match(docs(spark, sf), TERMS, 2).withColumn("hits", F.col("hits").cast("long"))


DUCK_TEXT = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(?:script)\\b.*?</script\\s*>|<(?:style)\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<head\\b.*?</head\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"""
DUCK_PLAIN = f"trim(replace(replace(replace(replace(replace({DUCK_TEXT}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'))"


@query("visible_text", f"SELECT page_id, md5({DUCK_PLAIN}) AS digest, length({DUCK_PLAIN}) AS chars FROM pages")
def visible_text(spark, sf):
    t = spread(table(spark, sf, "pages")).select("page_id", H.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@query(
    "page_topic_gate",
    f"""WITH p AS (SELECT page_id, {DUCK_PLAIN} AS body, regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1) || ' ' || url || ' ' || {DUCK_PLAIN}), '[^a-z0-9]+', ' ', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN length(body) < 60 THEN 'thin' WHEN CAST(contains(s, 'the') AS INT) + CAST(contains(s, 'ment') AS INT) + CAST(contains(s, 'keit') AS INT) >= 2
  THEN 'on topic' ELSE 'off topic' END AS verdict FROM p""",
)
def page_topic_gate(spark, sf):
    p = spread(table(spark, sf, "pages"))
    facts = p.select(
        "page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), H.visible_text(F.col("html")).alias("body")
    )
    return T.page_topic_gate(facts, ["the", "ment", "keit"], 2)


# ------------------------------------------------------------------ junk, messages, danger
REMARKS = """SELECT o_orderkey AS doc_id, 'Customer ' || CAST(o_custkey AS STRING) || ' wrote about the order and its state, at some length: ' ||
  CASE o_orderkey % 12 WHEN 0 THEN 'Lorem IPSUM dolor' WHEN 1 THEN 'total undefined.' WHEN 2 THEN 'sum: NaN!' WHEN 3 THEN '[object Object]' WHEN 4 THEN 'TODO: fix'
    WHEN 5 THEN 'name null, sorry' WHEN 6 THEN 'Dear {{ user.name }}' WHEN 7 THEN 'Fatal error in line 3' WHEN 8 THEN 'Coming Soon' WHEN 9 THEN 'nullable undefinedness' ELSE 'fine' END
  || ' - end of remark ' || o_orderpriority AS text FROM {orders}"""


@query(
    "junk_text",
    """SELECT doc_id, CASE k WHEN 0 THEN 'lorem ipsum' WHEN 1 THEN 'undefined' WHEN 2 THEN 'NaN' WHEN 3 THEN '[object Object]' WHEN 4 THEN 'TODO/FIXME'
  WHEN 5 THEN 'null value shown' WHEN 6 THEN 'template placeholder' WHEN 7 THEN 'Error text' ELSE 'test placeholder' END AS label,
  substr(text, greatest(instr(text, m) - 60, 1)::BIGINT, 180) AS excerpt FROM (SELECT doc_id, text, doc_id % 12 AS k,
  CASE doc_id % 12 WHEN 0 THEN 'Lorem IPSUM' WHEN 1 THEN ' undefined.' WHEN 2 THEN ' NaN!' WHEN 3 THEN '[object Object]' WHEN 4 THEN 'TODO:' WHEN 5 THEN ' null,'
  WHEN 6 THEN '{{ user.name }}' WHEN 7 THEN 'Fatal error' WHEN 8 THEN 'Coming Soon' END AS m FROM (""" + REMARKS + """)) WHERE k <= 8""",
)
def junk_text(spark, sf):
    rows = shaped(spark, sf, REMARKS)
    return rows.select("doc_id", F.explode(X.junk_hits(F.col("text"))).alias("j")).select("doc_id", "j.label", "j.excerpt")


ANSWERS = """SELECT event_id AS id, CASE event_id % 6
  WHEN 0 THEN '{"code": 1, "message" : "No referred users ' || props || '"}' WHEN 1 THEN '{"Detail":"date_from is required"}'
  WHEN 2 THEN 'plain   answer ' || props WHEN 3 THEN '{"msg":"nothing found"} eyJhbGci.eyJzdWIi.c2ln-' || props
  WHEN 4 THEN '' ELSE '{"error":"list is empty, access denied"}' END AS body FROM {events}"""


@query(
    "answer_messages",
    """SELECT id, CASE id % 6 WHEN 0 THEN regexp_extract(body, '"message" : "([^"]*)"', 1) WHEN 1 THEN 'date_from is required' WHEN 3 THEN 'nothing found'
  WHEN 5 THEN 'list is empty, access denied' ELSE body END AS message,
  CASE id % 6 WHEN 2 THEN replace(body, 'plain   ', 'plain ') WHEN 3 THEN regexp_replace(body, ' eyJ.*-', ' <token>') ELSE body END AS redacted
FROM (""" + ANSWERS + ")",
)
def answer_messages(spark, sf):
    a = shaped(spark, sf, ANSWERS)
    return a.select("id", X.answer_message(F.col("body")).alias("message"), X.redact_body(F.col("body")).alias("redacted"))


@query(
    "error_excerpts",
    """SELECT doc_id, CASE WHEN k = 7 THEN replace(substr(text, greatest(instr(text, 'error') - 80, 1)::BIGINT, 240), chr(10), ' ') ELSE left(text, 200) END AS excerpt
FROM (SELECT doc_id, doc_id % 12 AS k, text FROM (""" + REMARKS + """))""",
)
def error_excerpts(spark, sf):
    rows = shaped(spark, sf, REMARKS)
    return rows.select("doc_id", X.error_excerpt(F.col("text")).alias("excerpt"))


CONTROLS = """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Delete ' || p_name WHEN 1 THEN 'Payment history' WHEN 2 THEN 'Pay now'
  WHEN 3 THEN 'How do I withdraw?' WHEN 4 THEN p_name WHEN 5 THEN 'Sign out' WHEN 6 THEN 'buy options' WHEN 7 THEN 'Удалить' ELSE 'Çıxış' END AS text,
  CASE WHEN p_partkey % 2 = 0 THEN '<button>' ELSE '<button data-do=remove>' END AS html FROM {part}"""


@query(
    "danger_words",
    "SELECT id, id % 9 IN (0, 2, 3, 5, 7, 8) AS by_text, id % 9 IN (0, 2, 3, 5, 7, 8) OR id % 2 = 1 AS by_markup FROM (" + CONTROLS + ")",
)
def danger_words(spark, sf):
    c = shaped(spark, sf, CONTROLS)
    return c.select(
        "id", X.is_dangerous(F.col("text")).alias("by_text"), X.is_dangerous(F.col("text"), F.col("html")).alias("by_markup")
    )
