"""Text expressions: words, snippets, junk, messages, danger words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions.html import collapse

WORD = r"\p{L}+(?:['’]\p{L}+)*"


def words(text: Column) -> Column:
    """Letter runs; inner apostrophes stay."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def looks_english(lang: Column, word_list: Column) -> Column:
    """A declared language decides; otherwise 30 words and over 5% stop words."""
    code = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    stop = F.filter(word_list, lambda w: F.lower(w).isin(*seeds.ENGLISH_STOP_WORDS))
    return (
        F.when(code.startswith("en"), True)
        .when(code != "", False)
        .when(F.size(word_list) < 30, False)
        .otherwise(F.size(stop) / F.size(word_list) > 0.05)
    )


def same_case(right: Column, shown: Column) -> Column:
    """``right`` written the way ``shown`` is: ALL CAPS, Capitalised or as it is."""
    caps = (F.upper(shown) == shown) & (F.lower(shown) != shown) & (F.length(shown) > 1)
    initial = F.left(shown, F.lit(1))
    capital = (F.upper(initial) == initial) & (F.lower(initial) != initial)
    return (
        F.when(caps, F.upper(right))
        .when(capital, F.concat(F.upper(F.left(right, F.lit(1))), F.substr(right, F.lit(2))))
        .otherwise(right)
    )


def quoted(word: Column) -> Column:
    """The word as a literal piece of a regex."""
    return F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def context(text: Column, word: Column) -> Column:
    """50 characters on both sides of the first whole-word hit; '' without a hit."""
    rx = F.concat(F.lit(r"(?iu)(?<!\p{L})"), quoted(word), F.lit(r"(?!\p{L})"))
    at = F.regexp_instr(text, rx)
    a = F.greatest(at - 1 - 50, F.lit(0))
    b = F.least(F.length(text), at - 1 + F.length(word) + 50)
    body = collapse(F.substr(text, a + 1, b - a))
    return F.when(at == 0, "").otherwise(
        F.concat(
            F.when(a > 0, "…").otherwise(""), body, F.when(b < F.length(text), "…").otherwise("")
        )
    )


def topic_norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")


def junk_hits(text: Column) -> Column:
    """Array of (label, excerpt) for debug text left on a page; the excerpt holds
    180 characters from 60 before the first place the found words stand."""
    rows = []
    for label, rx in seeds.JUNK_TEXT_PATTERNS:
        found = F.regexp_extract(text, rx, 0)
        start = F.greatest(F.instr(text, found) - 61, F.lit(0))
        rows.append(
            F.when(
                text.rlike(rx),
                F.struct(F.lit(label).alias("label"), F.substr(text, start + 1, F.lit(180)).alias("excerpt")),
            )
        )
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def answer_message(body: Column) -> Column:
    """The human message in an API answer, else the answer itself."""
    raw = F.coalesce(body, F.lit(""))
    field = F.regexp_extract(raw, seeds.MESSAGE_FIELD, 1)
    return F.when(field != "", field).otherwise(raw)


def redact_body(body: Column, limit: int | None = 300) -> Column:
    """One line, tokens blanked, the first ``limit`` characters (None: all)."""
    one_line = collapse(F.coalesce(body, F.lit("")))
    whole = F.regexp_replace(one_line, seeds.TOKEN_LIKE, "<token>")
    return whole if limit is None else F.left(whole, F.lit(limit))


def error_excerpt(text: Column) -> Column:
    """240 characters from 80 before the first error word; 200 from the start without one."""
    at = F.regexp_instr(text, F.lit(seeds.ERROR_TEXT))
    start = F.greatest(at - 1 - 80, F.lit(0))
    hit = F.replace(F.substr(text, start + 1, F.lit(240)), F.lit("\n"), F.lit(" "))
    return F.when(at == 0, F.left(text, F.lit(200))).otherwise(hit)


_DANGER = "(?iU)" + "|".join(seeds.DANGER_PATTERNS)


def is_dangerous(text: Column, html: Column | None = None) -> Column:
    """Danger words present, unless all are soft money words in a reading context."""
    t = F.coalesce(text, F.lit(""))
    blob = F.concat(t, F.lit(" "), F.coalesce(html, F.lit("")) if html is not None else F.lit(""))
    hits = F.regexp_extract_all(blob, F.lit(_DANGER), 0)
    soft = F.forall(hits, lambda h: F.lower(F.trim(h)).isin(*seeds.SOFT_DANGER_WORDS))
    return (F.size(hits) > 0) & ~(soft & t.rlike(seeds.READING_CONTEXT))


def has_danger_word(text: Column) -> Column:
    return text.rlike(_DANGER)
