"""op12: exact copies, every row judged."""

from webloom.llm.exact import exact_duplicates
from webloom.llm.registry import query, table

SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) text_sha256 from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 kept, text_sha256
from d window w as (partition by text_sha256)
"""


@query("op12_exact_duplicates", SQL)
def op12_exact_duplicates(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
