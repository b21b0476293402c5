"""op11: documents drawn towards the distribution of the benchmark."""

from webloom.llm.registry import query, table
from webloom.llm.resample import resample

SQL = """
with steps as (
  select list(list_reduce([i] || range(8), lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) tab
  from (select unnest(range(256)) i)
), words as (
  select doc_id, k, unnest(list_filter(string_split_regex(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) w
  from (select doc_id, 0 k, coalesce(text, '') t from documents union all select item_id, 1, coalesce(text, '') from benchmark)
), kinds as (
  select distinct w from words
), bytes as (
  select w, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint) b from kinds
), buckets as (
  select w, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 bucket from bytes, steps
), hits as (
  select doc_id, k, bucket from words join buckets using (w)
), counts as (
  select bucket, count(*) filter (k = 0) s, count(*) filter (k = 1) t from hits group by bucket
), totals as (
  select coalesce(sum(s), 0)::double ss, coalesce(sum(t), 0)::double tt from counts
), gains as (
  select bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint gain from counts, totals
), weights as (
  select doc_id, count(*) n_features, sum(gain)::bigint weight from hits join gains using (bucket) where k = 0 group by doc_id
), scores as (
  select d.doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  from documents d left join weights using (doc_id)
), places as (
  select *, row_number() over (order by score desc, doc_id) p, count(*) over () n from scores where n_features >= 20
)
select s.doc_id, s.n_features, s.weight, s.score, case when p <= n * 10 // 100 then p end rank
from scores s left join places using (doc_id)
"""


@query("op11_importance_resampling", SQL)
def op11_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
