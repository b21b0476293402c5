"""op9: copies of lines, exact or within two edits."""

from webloom.llm.line_dedup import DISTANCE, MIN_CHARS, line_dedup
from webloom.llm.registry import query, table

SQL = f"""
with d as (
  select row_number() over (order by doc_id) r, doc_id, text from documents
), raw as (
  select r, doc_id, unnest(string_split(text, chr(10))) l, unnest(range(0, len(string_split(text, chr(10))))) pos from d
), lines as (
  select r, pos, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) l from raw where regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), firsts as (
  select l, min(r * 1000000 + pos) f from lines group by l
), long_lines as (
  select l, f, length(l) n from firsts where length(l) >= {MIN_CHARS}
), near as (
  select distinct b.l from long_lines a join long_lines b on a.n between b.n - {DISTANCE} and b.n + {DISTANCE} and a.f < b.f
  where levenshtein(a.l, b.l) <= {DISTANCE}
), gone as (
  select r, pos, near.l is not null near from lines join firsts using (l) left join near using (l)
  where near.l is not null or r * 1000000 + pos <> f
), g as (
  select r, count(*) filter (not near) e, count(*) filter (near) n, string_agg(pos::varchar, ',' order by pos) removed from gone group by r
)
select doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint n_lines, coalesce(e, 0)::bigint n_exact,
  coalesce(n, 0)::bigint n_near, coalesce(removed, '') removed
from d left join g using (r)
"""


@query("op9_line_dedup", SQL)
def op9_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))
