"""op6: near-duplicate groups of documents."""

from webloom.llm.minhash import near_duplicates
from webloom.llm.registry import query, table

SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents
), sh as (
  select doc_id, hash(s) s from (
    select distinct doc_id, array_to_string(ws[i:i + 4], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from w where len(ws) > 0))
), n as (
  select doc_id, count(*) n from sh group by 1
), common as (
  select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)
), pairs2 as (
  select x, y from links union select y, x from links
), reach as (
  select doc_id, doc_id r from w union select reach.doc_id, pairs2.y from reach join pairs2 on pairs2.x = reach.r
), least_id as (
  select doc_id, min(r) component_id from reach group by 1
)
select doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from least_id left join n using (doc_id)
"""


@query("op6_near_duplicates", SQL)
def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
