"""op5: packing of all documents. SQL has no tokenizer; tests unpack the rows exactly."""

import public_tokenizers

from webloom.llm.packing import pack_documents
from webloom.llm.registry import query, table


@query("op5_sum_of_squares_packing")
def op5_sum_of_squares_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
