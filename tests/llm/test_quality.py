"""Line frequency per host held to a count by hand."""

import hashlib

from webloom.llm import quality

#: Lines in the order of their hashes: the first is the smallest of every document that holds it.
SHARED = sorted((f"shared line {c} of the page footer" for c in "abcdef"), key=lambda x: hashlib.md5(x.encode()).digest())
OWN = [f"own words {w} that no other page of this host has" for w in ("red", "blue", "green", "white")]


def test_lines_count_distinct_documents(spark):
    pages = [("h", "\n".join([*SHARED, own])) for own in OWN]
    pages += [("copies", "\n".join([*SHARED, OWN[0]]))] * 9 + [(None, "\n".join([SHARED[0], own, own])) for own in OWN]
    pages += [("h", None), ("h", " \n")]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(pages)], "doc_id long, source string, text string")
    got = {r.doc_id: r.n_frequent_lines for r in quality.line_quality(docs, max_docs=3).collect()}
    want = [6] * 4 + [0] * 9 + [1] * 4 + [0, 0]
    assert [got[i] for i in range(len(pages))] == want
    assert {r.n_frequent_lines for r in quality.line_quality(docs, max_docs=4).collect()} == {0}
