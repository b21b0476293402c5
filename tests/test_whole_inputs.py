"""Link intersect reads all referrers; topic terms take one path."""

from webloom.operators import authority as A
from webloom.operators import index as I
from webloom.operators import topics


def test_referrers_past_the_lists_count(spark):
    links = [(f"s{i:02d}.com", t) for i in range(70) for t in ("me.com", "rival.com")] + [("new.com", "rival.com")]
    edges = spark.createDataFrame([(f"https://{s}/", s, f"https://{t}/", t, 0, 0) for s, t in links],
        "source_url string, source_domain string, target_url string, target_domain string, internal int, nofollow int")
    names = sorted({d for x in links for d in x})
    board = spark.createDataFrame([(d, 100 - i, 1, 1) for i, d in enumerate(names)], "domain string, authority int, referring_domains long, backlinks long")
    got = A.link_intersect(I.scored_referrers(edges, board), board, "me.com").collect()
    assert [(r.domain, r.rivals) for r in got] == [("new.com", 1)]


def test_topic_terms_have_one_path(spark):
    rows = [(1, "solar power here"), (1, "solar"), (1, "solar"), (2, "ab powers"), (None, "solar power")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["solar", "solar power", "power", "ab"]
    want = sorted((str(k), t) for k, x in rows for t in names if t in x and not any(o != t and o in t and o in x for o in names))
    table = spark.createDataFrame([(n,) for n in names], "term string")
    hits = lambda terms: sorted((str(r.doc_id), r.term) for r in topics.topic_hits(docs, terms).collect())
    assert hits(names) == want
    assert hits(table) == want
    filler = spark.range(2100).selectExpr("concat('zz', id) AS term")
    assert hits(table.unionByName(filler)) == want
