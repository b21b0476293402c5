"""op7: passages of 35 words that repeat."""

from webloom.llm.registry import query, table
from webloom.llm.substring import remove_repeats

SQL = """
with w as (
  select row_number() over (order by doc_id) r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents
), runs as (
  select r, i, hash(array_to_string(ws[i:i + 34], ' ')) h from (select r, ws, unnest(range(1, len(ws) - 33)) i from w where len(ws) >= 35)
), again as (
  select r, i from (select *, count(*) over (partition by h) n from runs) where n > 1
), gone as (
  select r, list(distinct i + d) g from again, (select unnest(range(0, 35)) d) group by r
), kept as (
  select doc_id, len(ws)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
    array_to_string(case when g is null then ws else list_filter(ws, lambda x, i: not list_contains(g, i)) end, ' ') t
  from w left join gone using (r)
)
select doc_id, n_words, n_removed, sha256(t) kept_sha256 from kept
"""


@query("op7_repeated_passages", SQL)
def op7_repeated_passages(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
