"""Findings, texts, crawl rules and report files on small inputs."""

import json
import os
import random
import urllib.robotparser

from pyspark.sql import functions as F

from webloom.functions import predicates as P
from webloom.operators import crawl as C
from webloom.operators import diff as D
from webloom.operators import findings as G
from webloom.operators import rules as R
from webloom.operators import spelling as S
from webloom.operators import tech as E
from webloom.operators import topics as T
from webloom.operators import traffic as N
from webloom.sources import pages as SP
from webloom.sources import reports as SR


def test_merge_findings_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        rows.append((
            i, rnd.choice(["high", "low"]), rnd.choice(["A", "B"]), rnd.choice(["t1", "t2"]), "", f"u{rnd.randrange(60)}" if rnd.random() > 0.05 else "",
            None, {}, rnd.choice([None, "", f"s{i}"]), "", rnd.randint(1, 3), [f"u{rnd.randrange(60)}" for _ in range(rnd.choice([0, 0, 3]))],
        ))
    want = {}
    for r in rows:
        k = (r[2], r[3])
        if k not in want:
            want[k] = {"sev": r[1], "url": r[5], "n": r[10], "others": list(r[11]), "shot": r[8]}
            continue
        w = want[k]
        w["n"] += r[10]
        if r[5] and r[5] != w["url"] and r[5] not in w["others"] and len(w["others"]) < 25:
            w["others"].append(r[5])
        w["shot"] = w["shot"] or r[8]
    df = spark.createDataFrame(rows, G.SCHEMA).repartition(5)
    got = {(r.category, r.title): r for r in G.merge_findings(df).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        r = got[k]
        assert (r.severity, r.url, r.occurrences, r.other_urls, r.screenshot) == (w["sev"], w["url"], w["n"], w["others"], w["shot"])


def test_gates_and_search(spark):
    f = spark.createDataFrame([(1, "low", "A", "t", "Detail", "u", None, {"k": "Needle"}, None, "", 1, [])], G.SCHEMA)
    assert G.fails(f, "low") and not G.fails(f, "medium")
    assert G.search(f, q="needle").count() == 1 and G.search(f, q="none").count() == 0
    changes = spark.createDataFrame([("new", "medium", None), ("changed", "high", "worse")], "change string, severity string, trend string")
    assert D.fails_new(changes, "high") and not D.fails_new(changes, "critical")


def test_extra_rule(spark):
    pages = spark.createDataFrame([(1, "https://h.test/", "<html lang=en><title>x</title><p>" + "word " * 20)], "page_id long, url string, html string")
    rule = lambda facts: G.shaped_findings(facts, seq=F.col("page_id"), severity="info", category="Own", title="Mine", url=F.col("url"))
    titles = {r.title for r in R.page_findings(pages, extra=[rule]).collect()}
    assert "Mine" in titles and "No meta description" in titles


def test_spelling_on_a_page(spark):
    docs = [(1, "See the COMMISION table. The COMMISSION is paid and recieve is wrong, Recieve too.", ["COMMISION", "Forget Password?"], "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, ui array<string>, lang string")
    book = spark.createDataFrame([("recieve", "receive")], "wrong string, right string")
    got = [r.title for r in S.text_findings(df, book).orderBy("place").collect()]
    assert got == [
        "Spelling mistake: 'recieve' should be 'receive'",
        "Wrong phrase: 'Forget Password?' should be 'Forgot Password?'",
        "Same word spelled two ways: 'COMMISSION' and 'COMMISION'",
    ]
    book2 = spark.createDataFrame([("commision", "commission")], "wrong string, right string")
    row = S.misspellings(S.english(df), book2).first()
    assert (row.shown, row.suggestion, row.times, row.in_ui) == ("COMMISION", "COMMISSION", 2, True)
    assert row.context.startswith("See the COMMISION table")


def test_topics_beyond_the_inline_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Discard the Payments - ai!"), (2, "no"), (3, "cards")], "doc_id long, text string")
    terms = ["card", "payment", "payments", "ai", "zz"]
    want = {(1, "card"), (1, "payment"), (1, "ai"), (3, "card")}
    assert {tuple(r) for r in T.topic_hits(docs, terms).collect()} == want
    monkeypatch.setattr(T, "BLOCK_CHARS", 9)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    assert {tuple(r) for r in T.topic_hits(docs, table).collect()} == want


def test_robots_equal_the_standard_library(spark):
    texts = [
        "User-agent: *\nDisallow: /pricing\n", "User-agent: *\nAllow: /\n", "User-agent: *\nDisallow:\n\nUser-agent: Bot\nDisallow: /\n",
        "# c\nUser-agent: a\nUser-agent: bot\nAllow: /p/ok\nDisallow: /p\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /\n", "Disallow: /\n", "",
        "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\n", "User-agent: bo\nDisallow: /a\n\nUser-agent: bot\nDisallow: /b\nUser-agent: *\nDisallow: /\n",
        "User-agent: *\nDisallow: /caf%C3%A9\nDisallow: /x%2fy\n", "User-agent: *\n\nDisallow: /a\nUser-agent: bot\n# note\n  \nDisallow: /b\nUser-agent: *\nDisallow: /\n",
    ]
    paths = ["/", "/pricing", "/pricing/x", "/p/ok", "/p/no", "/q?x=1", "/a", "/b", "/café", "/caf%c3%a9", "/x%2Fy", "/x/y"]
    pages = [(f"http://h{i}.test{p}",) for i in range(len(texts)) for p in paths]
    robots = [(f"http://h{i}.test", 200, t) for i, t in enumerate(texts)]
    got = C.robots_allowed(
        spark.createDataFrame(pages, "url string"), spark.createDataFrame(robots, "origin string, status int, body string"), "Bot/1.0"
    ).collect()
    for r in got:
        rp = urllib.robotparser.RobotFileParser()
        rp.parse(texts[int(r.url[8])].splitlines())
        assert r.allowed == (rp.can_fetch("Bot", r.url) or rp.can_fetch("*", r.url)), r.url
    assert {r.crawl_delay for r in got if r.url.startswith("http://h3")} == {3.0}


def test_patterns_are_searched_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 2)
    pages = spark.createDataFrame(
        [(1, "http://a.test/", [], [], '<x "foo">', {"server": "Zed"}, {}, "", []), (2, "http://b.test/[x", [None, "lib.js"], None, None, {}, {}, None, None)],
        "page_id long, url string, script_src array<string>, scripts array<string>, html string, headers map<string,string>, meta map<string,string>, cookies string, globals array<string>",
    )
    book = [("A", "html", None, "(AAA)zzz"), ("A", "html", None, "([\"'])foo\\1"), ("B", "url", None, "[x"), ("C", "header", "Server", "^z"), ("D", "script_src", None, "LIB"), ("E", "html", None, "nope")]
    found = E.detect_tech(pages, spark.createDataFrame(book, "tech string, field string, key string, pattern string"))
    assert sorted(map(tuple, found.collect())) == [(1, "A"), (1, "C"), (2, "B"), (2, "D")]


def test_findings_of_a_page_are_not_cut(spark):
    html = "<html><body>" + '<a href="/x"></a>' * 60 + "".join(f'<iframe src="/f" title="t{i}"></iframe>' for i in range(20)) + '<iframe src="/late"></iframe>' + "".join(
        f'<a href="mailto:a{i}@x.test">b{i}@x.test</a>' for i in range(7)) + "</body></html>"
    rows = R.page_findings(spark.createDataFrame([(1, "http://a.test/", html)], "page_id long, url string, html string")).collect()
    assert [r.occurrences for r in rows if r.title == "Links with no readable text"] == [60]
    assert [r.evidence["src"] for r in rows if r.title.startswith("iframe without")] == ["/late"]
    assert sum(r.title.startswith("Contact link") for r in rows) == 7
    assert len({r.seq for r in rows}) == len(rows)


def test_offline_streak_over_slots(spark, monkeypatch):
    monkeypatch.setattr(C, "SLOT_ROWS", 2)
    rnd = random.Random(2)
    rows = [(run, i, rnd.random() < 0.6) for run in range(6) for i in range(40)]
    df = spark.createDataFrame([(r, i, True, "ERR_NAME_NOT_RESOLVED" if o else "other") for r, i, o in rows], "run int, seq int, failed boolean, error string")
    want = {}
    for run in range(6):
        n = 0
        for r, i, o in rows:
            if r == run:
                n = n + 1 if o else 0
                if n == 4:
                    want[run] = i
                    break
    assert {r.run: r.stop_seq for r in C.offline_stops(df, 4).collect()} == want


def test_action_delta_over_slots(spark, monkeypatch):
    monkeypatch.setattr(N, "SLOT", 5)
    acts = spark.createDataFrame([("p", 1, 1), ("p", 30, 2), ("q", 50, 3)], "page_url string, at long, action_id long")
    ev = spark.createDataFrame([("p", 0, "early"), ("p", 1, "same"), ("p", 29, "far"), ("p", 31, "next"), ("q", 99, "late")], "page_url string, at long, event string")
    got = {(r.action_id, r.event) for r in N.action_delta(acts, ev).collect()}
    assert got == {(1, "same"), (1, "far"), (2, "next"), (3, "late")}


def test_predicates(spark):
    rows = [
        ("xhr", 401, "https://h/api/me", "", True, False), ("image", 401, "https://h/api/me", "", False, False),
        ("fetch", 400, "https://h/theme", '{"message":"No referred users"}', False, True), ("fetch", 404, "https://h/x?token=1", "empty", False, True),
        ("fetch", 400, "https://h/x", "no access to data", False, False),
    ]
    df = spark.createDataFrame(rows, "rt string, st int, url string, body string, probe boolean, e boolean")
    bad = df.where((P.is_auth_probe(F.col("rt"), F.col("st"), F.col("url")) != F.col("probe")) | (P.is_empty_answer(F.col("st"), F.col("body")) != F.col("e")))
    assert [r.url for r in bad.collect()] == []


def test_seed_and_term_files(spark, tmp_path):
    p = tmp_path / "seeds.txt"
    p.write_text("a.com\n\n # no\n#x\nhttp://b.com \n")
    assert [r.seed for r in SP.read_seeds(spark, str(p)).collect()] == ["https://a.com", "http://b.com"]
    q = tmp_path / "terms.txt"
    q.write_text("# c\nOpen  Banking!\n\n # odd\n")
    assert [r.term for r in SP.read_terms(spark, str(q)).collect()] == ["open banking", "odd"]


def test_report_files(spark, tmp_path):
    f = lambda i, sev, url: {"id": i, "severity": sev, "category": "C", "title": "T" + i[:1], "url": url, "element": None}
    for name, found in (("20240102-0304", [f("a1", "low", "u1"), f("b1", "high", "u2")]), ("20240103-0506", [f("a2", "low", "u9"), f("c1", "info", "u3")])):
        d = tmp_path / "runs" / name
        d.mkdir(parents=True)
        data = {"meta": {"target": "https://h.test", "pages_tested": 2}, "summary": {"severity": {"high": 1}, "category": {}, "total": len(found)}, "findings": found}
        (d / "report.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "runs" / "20240104-0000").mkdir()
    (tmp_path / "runs" / "20240104-0000" / "report.json").write_text("{broken")
    hist = SR.run_history(spark, str(tmp_path / "runs")).collect()
    assert [(r.when, r.total, r.high) for r in hist] == [("2024-01-03 05:06", 2, 1), ("2024-01-02 03:04", 2, 1)]
    old, new = (SR.read_report(spark, str(tmp_path / "runs" / n / "report.json")) for n in ("20240102-0304", "20240103-0506"))
    changes = D.diff(old, new)
    got = {(r.change, r.id, r.was_url) for r in changes.collect()}
    assert got == {("moved", "a2", "u1"), ("fixed", "b1", None), ("new", "c1", None)}
    out = str(tmp_path / "out")
    SR.write_diff(changes, D.diff_counts(old, new, changes), out)
    assert spark.read.json(os.path.join(out, "changes")).count() == 3
    (tmp_path / "other.json").write_text('{"a": 1}')
    try:
        SR.read_report(spark, str(tmp_path / "other.json"))
        raise AssertionError("accepted a file without findings")
    except ValueError:
        pass
    assert SR.same_target(spark, str(tmp_path / "runs" / "20240102-0304"), str(tmp_path / "runs" / "20240103-0506"))
