"""Static HTML expressions against Python's standard library and small pages."""

import html as stdlib

from pyspark.sql import functions as F

from webloom.functions import html as H

TEXTS = [
    "a &amp; b &lt;c&gt; &quot;d&quot; &nbsp;e", "&copy 2020 &copy; &notit; &notin; &amp", "&#65;&#x42;&#8364 &#x20AC;",
    "&#128; &#0; &#xD800; &#1114112; &#13; &#1; &#99999999999;", "no references", "&unknown; & &; &&amp;amp;", "&ampersand;",
    "&CounterClockwiseContourIntegral;&sup2&sup;", "&#xfdd0;x", "&AMP;&aMp;", "&;&#;&#x;",
]


def test_unescape_equals_standard_library(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", H.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: stdlib.unescape(t) for i, t in enumerate(TEXTS)}


PAGE = """<!doctype html><HTML lang="en"><head><title>A &amp; B</title><style>p{a:1>0}</style></head>
<body><!-- <a href="/no">no</a> --><script>var x = '<a href="/never">';</script>
<p>Hello&nbsp;<b>w</b>orld<br>again</p><a href='/x?a=1&amp;b="2"' title="a>b" REL=NoFollow>Go <i>on</i>
<a class="c d e" href=/bare data-x><img src=i.png alt=" pic "></a><svg><text>drawn</text></svg>&lt;i&gt;</body></html>"""


def test_markup_attributes_and_text(spark):
    df = spark.createDataFrame([(PAGE,)], "h string").select("h", H.markup(F.col("h")).alias("m"))
    a = H.blocks(F.col("m"), "a")
    row = df.select(
        F.transform(a, lambda c: H.attr(H.attrs(c), "href")).alias("href"),
        F.transform(a, lambda c: H.text_of(H.inner(c))).alias("text"),
        F.transform(a, lambda c: H.attr(H.attrs(c), "rel")).alias("rel"),
        F.transform(a, lambda c: H.has_attr(H.attrs(c), "data-x")).alias("bare"),
        F.transform(a, lambda c: H.accessible_name(c)).alias("name"),
        F.transform(a, lambda c: H.selector(H.tag_name(c), H.attrs(c))).alias("sel"),
        H.visible_text(F.col("h")).alias("vis"),
        F.size(H.tags(F.col("m"), r"[a-z][^\s/>]*")).alias("n"),
    ).first()
    assert row.href == ['/x?a=1&b="2"', "/bare"]
    assert row.text == ["Go on", ""]
    assert row.rel == ["NoFollow", None]
    assert row.bare == [False, True]
    assert row.name == ["Go on", "pic"]
    assert row.sel == ["a", "a.c.d"]
    assert row.vis == 'Hello w orld again b" REL=NoFollow>Go on <i>'
    assert row.n == 15
