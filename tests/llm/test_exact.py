"""Exact duplicates held to a plain count."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import exact

SCHEMA = "doc_id long, text string"


def plain(rows, normal=lambda t: t):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        winners = 0
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), winners == 0, hashlib.sha256(text.encode()).hexdigest()))
            winners += 1
    return sorted(out, key=repr)


def corpus():
    hot = [(i, "the hot text") for i in range(0, 900, 3)]
    own = [(i, f"text number {i % 211} ö") for i in range(1, 900, 3)]
    odd = [(2, None), (5, ""), (8, None), (None, "the hot text"), (None, "nobody"), (11, "twice"), (11, "twice"), (None, "void"), (None, "void"), (14, "x" * 300_000)]
    return hot + own + odd


@pytest.mark.parametrize("counters", [1, 2, 3, 64, exact.COUNTERS])
def test_every_row_is_judged_as_by_a_plain_count(spark, counters):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(7)
    got = sorted((tuple(r) for r in exact.exact_duplicates(docs, counters=counters).collect()), key=repr)
    assert got == plain(corpus())


def test_candidates_are_bounded_and_hold_all_frequent_digests(spark):
    rows = [(i % 5 if i % 2 else 1000 + i,) for i in range(4000)]
    digests = spark.createDataFrame(rows, "digest long").repartition(6).select(F.unhex(F.sha2(F.col("digest").cast("string"), 256)).alias("digest"))
    for counters in (1, 4, 9, 50):
        found = {bytes(r.digest) for r in exact.frequent_digests(digests, counters).collect()}
        assert len(found) <= counters
        frequent = {d for d, n in Counter(r[0] for r in rows).items() if n * (counters + 1) > 2 * len(rows)}
        assert {hashlib.sha256(str(d).encode()).digest() for d in frequent} <= found


def test_a_summary_falls_short_by_its_bound_at_most():
    counts = Counter({"a": 50, "b": 20, "c": 3, "d": 2, "e": 1})
    small = exact.shrink(counts, 2)
    assert small == Counter({"a": 47, "b": 17})
    assert all(counts[d] - small[d] <= sum(counts.values()) / 3 for d in counts)


def test_normal_forms_and_other_columns(spark):
    rows = [(1, "One", "a", True), (2, "one", "b", False), (3, "two", None, None), (3, "two", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, kept boolean")
    low = [tuple(r) for r in exact.exact_duplicates(docs, F.lower("text")).select("doc_id", "keep_id", "kept").collect()]
    assert sorted(low) == [(1, 2, False), (2, 2, True), (3, 3, False), (3, 3, True)]
    kept = exact.without_exact_duplicates(docs, F.lower("text"))
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([rows[1], rows[2]], key=repr)


def test_surviving_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = sorted((tuple(r) for r in exact.without_exact_duplicates(docs).collect()), key=repr)
    best = {}
    for i, t in corpus():
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((i if i is not None else -1, t or "") for i, t in got) == sorted((i, t) for t, i in best.items())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.exact_duplicates(docs).collect() == []
    assert exact.without_exact_duplicates(docs).collect() == []
