"""Stages of the pipeline: columns of any name, null and empty texts, empty tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

EXTRA = ["quality_key", "gone_lines", "line_key", "emptied", "gone_id", "kept", "bench_key", "bench_words", "bench_items", "contaminated", "component_id", "key", "text_2"]


def words(i, n=60):
    return " ".join(f"w{(i * 7919 + k * 104729) % 9973}x{k}" for k in range(n))


def documents(spark, empty=False):
    rows = [(i, words(i), "en", "host", 1) for i in range(8)] + [(20, None, None, None, 0), (21, "", "en", "host", 0), (22, words(3), "en", "other", 1), (23, "short", "en", "host", 5)]
    rows.append((24, words(50, 80), "en", "host", 1))
    full = [(*r, *[f"{c} of {r[0]}" for c in EXTRA]) for r in rows]
    return spark.createDataFrame([] if empty else full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, words(50, 80))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


#: Documents that go: no words or too few, those whose lines an earlier one has, near copies, benchmark items.
GONE = {"quality_rules": {20, 21, 23}, "line_dedup": {22}, "near_dedup": {22}, "benchmark_decontamination": {24}}


@pytest.mark.parametrize("name", list(GONE))
def test_columns_of_any_name_pass_through(spark, folder, name):
    stage = dict(pipeline.STAGES)[name]
    docs = documents(spark)
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} >= set(range(8)) - {3}
    assert not {r.doc_id for r in rows} & GONE[name]
    assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in EXTRA)
    assert stage(spark, documents(spark, empty=True), folder).collect() == []


def test_packing_of_an_empty_table(spark, folder):
    assert dict(pipeline.STAGES)["packing"](spark, documents(spark, empty=True), folder).collect() == []
