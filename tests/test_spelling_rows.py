"""Spelling inside the row held to plain Python; several steps of a large dictionary."""

import random
import re
from collections import Counter

from webloom import seeds
from webloom.operators import spelling as S

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def corpus():
    draw = random.Random(4)
    some = ["Recieve", "recieve", "RECIEVE", "teh", "address", "adress", "committee", "comittee", "commitee", "planned", "planed", "buying", "über", "don't"]
    docs = [(i, " ".join(draw.choice(some) for _ in range(draw.randrange(25))), "en", [draw.choice(some)] * draw.randrange(2)) for i in range(60)]
    return docs + [(60, None, "en", None), (61, "", "en", []), (62, "teh teh", "de", []), (1, "teh", "en", []), (63, "teh " * 30_000, "en", ["x", " "])]


def plain(docs, book):
    hits, variants = [], []
    for doc_id, text, lang, ui in docs:
        if lang != "en":
            continue
        ui = [u for u in ui or [] if u.strip()]
        words = WORD.findall("\n".join([text or "", "\n".join(ui)]))
        low = [w.lower() for w in words]
        count, shown = Counter(low), {}
        for w in words:
            shown.setdefault(w.lower(), w)
        in_ui = {w.lower() for w in WORD.findall("\n".join(ui))}
        hits.extend((doc_id, w, shown[w], count[w], w in in_ui) for w in count if w in book)
        for w in count:
            for i in range(len(w) - 1):
                one = w[: i + 1] + w[i + 2 :]
                good = re.fullmatch("[a-z]{7,}", w) and w[i] == w[i + 1] and w[i + 2 :] not in seeds.DOUBLING_SUFFIXES
                if good and one in count and w not in book and one not in book and not {(w, one), (one, w)} & {tuple(p) for p in seeds.VALID_SPELLING_PAIRS}:
                    rare, common = (one, w) if count[one] <= count[w] else (w, one)
                    variants.append((doc_id, shown[rare], shown[common], count[rare], count[common], rare in in_ui))
    return sorted(hits), sorted(set(variants))


def test_rows_equal_plain_python(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, ui array<string>").repartition(5)
    book = {"recieve": "receive", "teh": "the", "comittee": "committee"}
    table = spark.createDataFrame([(w.title(), r) for w, r in book.items()] + [(None, "x")], "wrong string, right string")
    hits, variants = plain(docs, book)
    for size in (S.BOOK_ROWS, 1):
        monkeypatch.setattr(S, "BOOK_ROWS", size)
        got = S.misspellings(S.english(df), table).select("doc_id", "low", "shown", "times", "in_ui").collect()
        assert sorted(map(tuple, got)) == hits
        got = S.spelling_variants(S.english(df), table).select("doc_id", "rare", "common", "rare_times", "common_times", "rare_in_ui").collect()
        assert sorted(map(tuple, got)) == variants
    assert variants and S.spelling_variants(S.english(df)).count() > len(variants)


def test_findings_are_one_scan_with_evidence(spark):
    df = spark.createDataFrame([(1, "Please recieve it. You could of called. The commission and a commision.", "en")], "doc_id long, text string, lang string")
    found = S.text_findings(df, spark.createDataFrame([("recieve", "receive")], "wrong string, right string"))
    rows = [(r.place, r.word, r.suggestion, r.times, r.context) for r in found.orderBy("place").collect()]
    assert [r[:4] for r in rows] == [(1, "recieve", "receive", 1), (2, "could of", "could have", 1), (3, "commision", "commission", 1)]
    assert rows[0][4].startswith("Please recieve it. You could of") and all(r[1] in r[4] for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_task_works_on_slices_and_hands_on_what_is_kept(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "SLICE_WORDS", 10)
    lists = [["planned", "planed"] * n for n in (1, 2, 0, 9, 1)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(5), pa.int64()), "words": lists, "lows": lists, "ui_words": pa.array([[]] * 5, pa.list_(pa.string())),
        "hits": pa.array([[]] * 5, pa.list_(pa.struct([("low", pa.string())])))})
    assert [part.num_rows for part in S._slices([batch, batch.slice(0, 0)])] == [3, 1, 1]
    out = list(S._vary(pa.list_(pa.struct([("single", pa.string()), ("double_times", pa.int64())])), ["doc_id", "variants"])([batch]))
    assert [part.schema.names for part in out] == [["doc_id", "variants"]] * 3
    assert [d for part in out for d in part.column("doc_id").to_pylist()] == [0, 1, 2, 3, 4]


def test_texts_that_nobody_reads_do_not_travel(spark):
    docs = spark.createDataFrame([(1, "They comitted and committed it.", "en")], "doc_id long, text string, lang string")
    assert S.told_rows(S.english(docs), kept=()).columns == ["doc_id", "hits", "variants"]
    (row,) = S.spelling_variants(S.english(docs)).collect()
    assert (row.doc_id, row.rare, row.common) == (1, "comitted", "committed")
