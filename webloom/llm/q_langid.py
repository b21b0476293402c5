"""op3: language of every document, learned from three of four folds; SQL has no mixture
inference."""

from pyspark.sql import functions as F

from webloom.llm.langid import identify, learn
from webloom.llm.registry import query, table


@query("op3_language_mixture")
def op3_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    names, model = learn(docs.where(~held).select("lang", "text"))
    return identify(docs, names, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
