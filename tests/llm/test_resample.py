"""Importance resampling held to a plain count of every run of words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def plain_buckets(text, max_n, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, max_n, buckets, min_words, percent, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_buckets(text, max_n, buckets))
    for text in target:
        t.update(plain_buckets(text, max_n, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        hits = plain_buckets(text, max_n, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in hits)
        rows.append([doc_id, len(hits), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=repr)


SOME = [
    "One line\nTwo lines here\nOne line", "ONE line", None, "", "\n\n \n", "…— ***", "Ünder über 12 naïve\n12 naïve", "a\nb\nc\nd a\nb", "x" * 100_000 + " y",
    "tail one line", "The same text", "The same text",
]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_equal_to_a_plain_count(spark, max_n):
    docs = [(i, t) for i, t in enumerate(SOME * 6)] + [(3, "One line"), (3, "One line"), (None, "One line and another")]
    target = ["One line", "two lines", None, "12 NAÏVE"]
    for min_words, percent in ((1, 30), (3, 100), (0, 7), (50, 10)):
        got = R.resample(
            spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"),
            max_n=max_n, buckets=97, min_words=min_words, percent=percent, seed="7")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, target, max_n, 97, min_words, percent, "7")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abB1 \n\t.ö一\x00\x7f"), max_size=40)), max_size=8), st.integers(1, 4))
def test_features_of_lines_and_over_their_ends(texts, max_n):
    got = R.LineFeatures(pa.array(texts, pa.string()), max_n, 31)
    want = [plain_buckets(t, max_n, 31) for t in texts]
    assert got.counts().tolist() == np.bincount([b for w in want for b in w], minlength=31).tolist()
    gains = np.arange(31) ** 2 - 300
    words, features, weights = got.per_text(gains)
    assert words.tolist() == [len(plain_words(t)) for t in texts]
    assert features.tolist() == [len(w) for w in want]
    assert weights.tolist() == [int(sum(gains[b] for b in w)) for w in want]


def test_a_distinct_line_is_hashed_once():
    got = R.LineFeatures(pa.array(["same line\n" * 50, "same line"], pa.string()), 2, 31)
    assert len(got.line_buckets) == 3  # two words and one pair, of 51 equal lines
    assert got.counts().sum() == 51 * 3 + 49


def test_ranks_over_many_partitions(spark):
    rows = [(i, i % 13) for i in range(500)] + [(None, 12), (7, 7)]
    stages = R.Stages(spark, "test-ranks")
    got = R.ranked(spark.createDataFrame(rows, "doc_id long, score long").repartition(9), 77, stages)
    ordered = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert sorted((r.rank, r.doc_id, r.score) for r in got.where("rank is not null").collect()) == [(i, d, s) for i, (d, s) in enumerate(ordered[:77], 1)]
    assert got.count() == len(rows)


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c", 5, 2.0), (2, "a", 6, 3.0)], "doc_id long, text string, score long, rank double")
    assert R.resample(none, none.select("text")).collect() == []
    assert [r.rank for r in R.resample(some, none.select("text"), min_words=1, percent=100).orderBy("doc_id").collect()].count(None) == 0
    drawn = R.drawn_documents(some, some.select("text"), min_words=2, percent=100)
    assert drawn.columns == some.columns and [r.doc_id for r in drawn.collect()] == [1]
