"""op13: collocations of each language."""

from webloom.llm.phrases import collocations
from webloom.llm.registry import query, table

SQL = """
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) p from documents
), words as (
  select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') ws from pieces
), runs as (
  select lang, d, unnest(list_transform(range(1, len(ws) - d + 2), lambda i: array_to_string(ws[i:i + d - 1], ' '))) phrase
  from words, (select unnest(range(1, 6)) d) where len(ws) >= d
), counts as (
  select lang, d, phrase, count(*) f from runs group by all
), totals as (
  select lang, sum(f)::bigint n from counts where d = 1 group by lang
), often as (
  select * from counts where f >= 100
), candidates as (
  select lang, d, phrase, f a, string_split(phrase, ' ') ws from often where d > 1
), inside as (
  select distinct s.lang, s.phrase from candidates s join (
    select lang, a, unnest(flatten(list_transform(range(2, d), lambda m: list_transform(range(1, d - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) part
    from candidates where d > 2
  ) q on q.lang = s.lang and q.part = s.phrase and 100 * q.a >= 100 * s.a
), cuts as (
  select lang, phrase, a, k, array_to_string(ws[1:k], ' ') lp, array_to_string(ws[k + 1:], ' ') rp
  from (select *, unnest(range(1, d)) k from candidates anti join inside using (lang, phrase))
), scored as (
  select c.lang, c.phrase, a, x.f l, y.f r, n, k, 1000::hugeint * a * n // (x.f::hugeint * y.f) score
  from cuts c join counts x on x.lang = c.lang and x.phrase = lp join counts y on y.lang = c.lang and y.phrase = rp join totals t on t.lang = c.lang
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score::bigint score
from best qualify rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
