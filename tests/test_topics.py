"""Topic terms held to a plain search, for lists and tables of any size."""

import random
import re

from webloom.operators import topics as T


def plain(rows, terms):
    norm = lambda s: re.sub(r"[^a-z0-9]+", " ", (s or "").lower())
    words = {norm(t).strip() for t in terms} - {""}
    out = []
    for key, text in rows:
        found = {w for w in words if w in norm(text)}
        out.extend((key, w) for w in found if not any(o != w and o in w for o in found))
    return sorted(out, key=repr)


def corpus():
    draw = random.Random(3)
    rows = [(i % 37, " ".join(draw.choice(["Card", "payments", "AI-day", "loan", "über", "x1", "Re-pay"]) for _ in range(draw.randrange(12)))) for i in range(80)]
    terms = ["".join(draw.choice("adeiloprxy1- ") for _ in range(draw.randrange(1, 5))) for _ in range(60)]
    return rows + [(None, "card"), (90, None), (91, ""), (5, "loan"), (5, "loan"), (92, "card " * 50_000)], terms + ["Card", "card  pay", "pay", "", "...", "loan x1", "LOAN"]


def test_equal_to_a_plain_search(spark, monkeypatch):
    rows, terms = corpus()
    docs = spark.createDataFrame(rows, "page long, body string").repartition(5)
    table = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    want = plain(rows, terms)
    for chars in (T.BLOCK_CHARS, 20):
        monkeypatch.setattr(T, "BLOCK_CHARS", chars)
        for given in (terms, table):
            assert sorted((tuple(r) for r in T.topic_hits(docs, given, "page", "body").collect()), key=repr) == want
    listed = sorted(((r.page, t) for r in docs.select("page", T.topic_hit_terms(docs["body"], terms).alias("ts")).collect() for t in r.ts), key=repr)
    assert listed == want


def test_a_long_table_is_one_scan_without_shuffled_texts(spark):
    docs = spark.createDataFrame([(1, "term 77 here"), (2, "none")], "doc_id long, text string")
    hits = T.topic_hits(docs, spark.range(1000, 20_000).selectExpr("concat('code ', id) AS term").unionAll(spark.sql("SELECT 'term 77' AS term")))
    assert [tuple(r) for r in hits.collect()] == [(1, "term 77")]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_no_terms_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a card")], "doc_id long, text string")
    assert T.topic_hits(docs, []).collect() == [] and T.topic_hits(docs, ["", "-"]).collect() == []
    assert T.topic_hits(docs.limit(0), ["card"]).collect() == []
