"""Collocations held to a plain count of all runs of words."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import phrases as P

SCHEMA = "doc_id long, lang string, text string"


def plain_counts(docs):
    counts, totals = Counter(), Counter()
    for _, lang, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for d in range(1, 6):
                counts.update((lang or "und", tuple(words[i : i + d])) for i in range(len(words) - d + 1))
    return counts, totals


def plain(docs, least, top):
    counts, totals = plain_counts(docs)
    often = {p: n for p, n in counts.items() if n >= least and len(p[1]) > 1}
    dropped = {(lang, w[i : i + m]) for (lang, w), n in often.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if n >= counts[lang, w[i : i + m]]}
    rows = []
    for (lang, w), a in often.items():
        if (lang, w) not in dropped:
            score, k = min((1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], totals[lang]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n, -score))
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "über", "a", "b", "c—d", "\x00z", "x"]
    docs = []
    for i in range(120):
        words = [draw.choice(vocabulary) + draw.choice(["", "", "", "", ",", ".", "!?", ";"]) for _ in range(draw.randrange(40))]
        words += ["New York City council meets"] * draw.randrange(3)
        docs.append((i, draw.choice(["en", "en", "de", None]), draw.choice([" ", "  ", "\t", " \n "]).join(words)))
    return docs + docs[:9] + [(500, "en", None), (501, None, ""), (None, "fr", "a a a a a a a a a a a a a"), (502, "es", "long " * 30_000)]


@pytest.mark.parametrize("hot_share", [1, 30, P.HOT_SHARE])
def test_equal_to_a_plain_count(spark, hot_share):
    docs = corpus(hot_share)
    got = P.collocations(spark.createDataFrame(docs, SCHEMA).repartition(6), min_count=8, top=25, hot_share=hot_share)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(docs, 8, 25))


def test_every_frequent_phrase_is_counted(spark):
    docs = corpus(5)
    totals, counts = P.phrase_counts(spark.createDataFrame(docs, SCHEMA), 4, 20, P.Stages(spark, "test-phrases"))
    want, n = plain_counts(docs)
    assert {(r.lang, r.phrase, r.words, r.n) for r in counts.collect()} == {(lang, " ".join(w), len(w), c) for (lang, w), c in want.items() if c >= 4}
    assert {r.lang: r.n for r in totals.collect()} == {lang: c for lang, c in n.items() if c}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=4), st.integers(1, 5), st.booleans()), max_size=30), st.integers(1, 12))
def test_equal_partitions_are_counts(rows, least):
    keys = np.array([[*r[0], -1, -1, -1, -1][:4] for r in rows], np.int64).reshape(len(rows), 4)
    weights, shared = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool)
    got = {tuple(keys[r, :d].tolist()): n for r, d, n in P.equal_partitions(keys, weights, least, shared)} if rows else {}
    want, loose = Counter(), set()
    for words, n, share in rows:
        for d in range(1, len(words) + 1):
            want[tuple(words[:d])] += n
            if share and d <= 3:
                loose.add(tuple(words[:d]))
    # below a light partition nothing is kept, so a longer one is there only if it is heavy itself
    assert got == {w: n for w, n in want.items() if n >= least or w in loose}


def test_lists_cut_into_chunks_are_shares(monkeypatch):
    docs = corpus(8)
    part = pa.RecordBatch.from_pydict({"lang": pa.array([d[1] for d in docs]), "text": pa.array([d[2] for d in docs])})
    bits = np.full(P.BITS // 8, 255, np.uint8)
    lists, bounds = P.Pieces(part).suffixes(bits, np.zeros(0, np.uint64), 3)
    assert bounds[0] == 0 and bounds[-1] == lists.num_rows
    halves = [lists.take(pa.array(np.arange(lists.num_rows)[k::2])) for k in (0, 1)]
    blocks = pa.RecordBatch.from_pydict({"part": pa.array([0, 0], pa.int32()), "block": pa.array([P.packed(h) for h in halves], pa.binary())})
    whole = {(r["lang"], r["phrase"]): r["n"] for b in P._sort(6)(iter([blocks])) for r in b.to_pylist()}
    assert whole == {(lang, " ".join(w)): n for (lang, w), n in plain_counts(docs)[0].items() if len(w) > 1 and n >= 6}
    monkeypatch.setattr(P, "CHUNK", 100)
    shares = Counter()
    for b in P._sort(6)(iter([blocks, blocks.slice(0, 0)])):
        for r in b.to_pylist():
            shares[r["lang"], r["phrase"]] += r["n"]
    assert {k: n for k, n in shares.items() if n >= 6} == whole


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) s "
                    "FROM VALUES (999999999999, 123456789012345, 1234567890123, 2345678901234) t(a, n, l, r)").first()
    assert row.s == 1000 * 999999999999 * 123456789012345 // (1234567890123 * 2345678901234)


def test_empty_table_and_other_columns(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "en", "a b. a b", "x", 3)], SCHEMA + ", phrase string, n int")
    assert [tuple(r) for r in P.collocations(docs, min_count=2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 2000)]
