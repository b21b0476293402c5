"""Costly expressions and tables that a query needs several times are worked out once."""

from pyspark.sql import functions as F

from webloom import plans
from webloom.functions import urls as U
from webloom.operators import findings as G
from webloom.operators import rules as R
from webloom.operators import tech as T
from webloom.operators import traffic as N
from webloom.plans.registry import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_and_its_base_are_normalised_once(spark, tmp_path):
    plans.load()
    rows = [(k, 5, "O", "1-URGENT") for k in range(32)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    facts = QUERIES["url_facts"](spark, str(tmp_path))
    assert optimized(facts).count("(?i)^(") == 2
    got = {r["id"]: r for r in facts.collect()}
    assert {5, 9, 12, 13}.isdisjoint(got) and len(got) == 24
    assert (got[0]["url"], got[0]["gate"], got[11]["gate"]) == ("https://www.shop5.example.co.uk/a/up/5", None, "document")


def test_found_technologies_are_read_once(spark):
    found = spark.range(4).select(F.col("id").alias("page_id"), F.when(F.col("id") < 2, "A").when(F.col("id") < 3, "C").alias("tech"))
    implies = spark.createDataFrame([("A", "B"), ("B", "C\\;confidence:50"), ("C", "C")], "tech string, implied string")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "tech string")
    out = T.implied(found.unionAll(found), implies, known)
    assert optimized(out).count("Range (") == 2
    assert sorted(map(tuple, out.where("tech is not null").collect())) == [(0, "A"), (0, "B"), (0, "C"), (1, "A"), (1, "B"), (1, "C"), (2, "C")]
    assert out.where("tech is null").count() == 1


def test_tags_are_read_once_and_absent_marks_change_nothing(spark):
    pages = spark.createDataFrame(
        [(1, "https://a/1", "<A HREF=/x></A><INPUT PLACEHOLDER=' Mail '><DIV ONCLICK=go()>Menu</DIV><IMG SRC=a>"), (2, "https://a/2", "no tags"), (3, "https://a/3", None)],
        "page_id long, url string, html string")
    facts = R.page_facts(pages)
    assert optimized(facts).count(f"(?is)<(?:{R.ANY})") == 1
    got = {r["page_id"]: r for r in facts.collect()}
    assert (got[1]["ui"], len(got[1]["traps"]), len(got[1]["nameless_links"]), len(got[1]["images"]), len(got[1]["fields"])) == (["Mail"], 1, 1, 1, 1)
    assert (got[2]["anchors"], got[2]["traps"], got[2]["fields"]) == ([], [], [])
    assert got[3]["anchors"] is None


def test_elements_are_sorted_by_a_number_first(spark):
    metrics = spark.createDataFrame([(1, "https://a/1", "m", 390, 500, False), (2, "https://a/2", "m", 390, 500, False)],
                                    "seq long, page_url string, label string, width int, scroll_width int, clipped boolean")
    elements = spark.createDataFrame([("https://a/1", "m", f"#e{i}", 400 + i % 4) for i in range(12)], "page_url string, label string, selector string, right long")
    out = N.overflow_findings(metrics, elements, widest=3)
    assert "xxhash64" in optimized(out)
    got = {r["url"]: r["evidence"]["widest_elements"] for r in out.collect()}
    assert got["https://a/1"] == '[{"selector":"#e11","right":403},{"selector":"#e3","right":403},{"selector":"#e7","right":403}]'
    assert got["https://a/2"] == "[]"


def counted(spark, findings):
    """The findings, and a count of how often their rows are worked out."""
    made = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return findings.mapInArrow(task, findings.schema), made


def some_findings(spark):
    rows = [(i, "high" if i % 2 else "low", "A", f"t{i % 3}", "", f"u{i % 40}", None, {"k": str(i)}, "", "", 1, []) for i in range(200)]
    return spark.createDataFrame(rows, G.SCHEMA).repartition(3)


def test_merged_findings_are_worked_out_once(spark):
    findings, made = counted(spark, some_findings(spark))
    got = G.merge_findings(findings).collect()
    assert sorted((r.title, r.seq, r.occurrences, len(r.other_urls)) for r in got) == [("t0", 0, 67, 25), ("t1", 1, 67, 25), ("t2", 2, 66, 25)]
    assert made.value == 200


def test_searched_findings_are_worked_out_once(spark):
    findings, made = counted(spark, some_findings(spark))
    got = G.search(findings, severity="high", q=" T2 ").collect()
    assert [r.seq for r in got] == [i for i in range(200) if i % 2 and i % 3 == 2]
    assert made.value == 200


def test_domains_are_cut_without_lists(spark):
    urls = {
        "https://www.Shop.co.uk:80/a//b.c/d": "b.c", "http://a.b.example.org/x": "example.org", "a///b.c.de/": "", "////x.y.z": "y.z", "x.co.uk": "x.co.uk",
        "a.co.info": "co.info", "co": "co", "": "", "http://": "", "//U@H.example.com:8/p?q": "example.com", "..com": ".com", "a.b.": "b.", None: None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.domain_of("u").alias("d"))
    assert {r.u: r.d for r in rows.collect()} == urls
    assert "lambda" not in optimized(rows)
