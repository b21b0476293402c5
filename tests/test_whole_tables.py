"""Registered text queries read their whole tables; the language gate decides."""

from webloom.plans import text

ENGLISH = "ther is the committment and the commitment of the house and it was not for the people who are in the town with this. " * 8


def test_documents_without_a_language_are_judged(spark, tmp_path):
    rows = [(1, ENGLISH, "en"), (2, ENGLISH, None), (3, ENGLISH, "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(1, 61).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "region.parquet"))
    sf = str(tmp_path)
    for q in (text.misspellings, text.misspelling_context, text.spelling_variants_documents):
        assert {r.doc_id for r in q(spark, sf).collect()} == {1, 2, 3}
    assert max(r.place for r in text.text_findings(spark, sf).collect()) > 3
