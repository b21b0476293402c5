"""op4: quality rules over documents."""

from webloom.llm.quality import MAX_DOCS, MIN_LEFT, line_quality
from webloom.llm.registry import query, table

SQL = f"""
with w as (
  select row_number() over (order by doc_id) r, doc_id, source, coalesce(text, '') t from documents
), words as (
  select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from w
), pos as (
  select r, ws, unnest(range(1, len(ws) - 3)) i from words where len(ws) >= 5
), wins as (
  select r, i, array_to_string(ws[i:i + 4], ' ') win from pos
), rep as (
  select r, i from (select *, count(*) over (partition by r, win) n from wins) where n > 1
), rep_words as (
  select r, count(distinct i + d) n from rep, (select unnest(range(0, 5)) d) group by r
), lines as (
  select r, source, md5(t) f, unnest(string_split(t, chr(10))) l from w
), full_lines as (
  select *, md5(trim(regexp_replace(regexp_replace(
      translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\\x09-\\x0d\\x20]+', ' ', 'g'), ' ')) k,
    len(list_filter(string_split_regex(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) lw
  from lines where regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), freq as (
  select source, k from full_lines group by 1, 2 having count(distinct f) > {MAX_DOCS}
), gone as (
  select r, count(*) n, sum(lw) lw from full_lines x join freq on x.k = freq.k and x.source is not distinct from freq.source group by r
), dups as (
  select r, count(*) - count(distinct l) n from full_lines group by r
), s as (
  select w.doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
    length(regexp_replace(words.t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(dups.n, 0)::bigint n_dup_lines,
    coalesce(rep_words.n, 0)::bigint n_repeat_words, coalesce(gone.n, 0)::bigint n_frequent_lines,
    (len(ws) - coalesce(gone.lw, 0))::bigint words_left
  from words join w using (r) left join dups using (r) left join rep_words using (r) left join gone using (r)
)
select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * words_left >= {MIN_LEFT} * n_words kept
from s
"""


@query("op4_quality_rules", SQL)
def op4_quality_rules(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"))
