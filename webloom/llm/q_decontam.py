"""op10: documents that hold benchmark passages, also re-parameterised ones; SQL has no
word classes."""

from pyspark.sql import functions as F

from webloom.llm.decontam import decontaminate
from webloom.llm.registry import query, table


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.coalesce(F.array_join(F.transform("bench_items", lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("doc_id", "contaminated", items.alias("items"), "bench_words", (~F.col("contaminated")).alias("kept"))
