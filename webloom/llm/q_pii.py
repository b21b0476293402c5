"""op2: personal data in documents. SQL cannot express the transducers; tests hold plain
spans against a brute-force version and disguises to examples."""

from pyspark.sql import functions as F

from webloom.llm.pii import find_pii
from webloom.llm.registry import query, table


@query("op2_pii_spans")
def op2_pii_spans(spark, sf_dir):
    """n_* count the plain spans, which base_sha256 covers; n_hidden those that only the method finds."""
    found = find_pii(table(spark, sf_dir, "documents"))
    hidden = F.size(F.filter("found", lambda x: ~x["plain"])).cast("long").alias("n_hidden")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", hidden)
