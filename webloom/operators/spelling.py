"""Spelling jobs over texts: known misspellings, set phrases, one word two ways.

Input ``docs``: doc_id, text, and optionally ``ui`` (array of short strings from
menus, buttons, headings) and ``lang``. The dictionary is a table (wrong, right).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webloom import seeds
from webloom.functions import text as X
from webloom.functions.html import collapse
from webloom.functions.urls import let

UI_NOTE = " It stands in a menu, button, link or heading."


def english(docs: DataFrame) -> DataFrame:
    """Documents in English, with their ui strings and ``body_words`` (text, then ui)."""
    have = set(docs.columns)
    no_list = F.array().cast("array<string>")
    ui = F.coalesce(F.col("ui"), no_list) if "ui" in have else no_list
    lang = F.col("lang") if "lang" in have else F.lit("")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"), F.filter(ui, lambda s: F.trim(s) != "").alias("ui"))
    listed = base.withColumn("body_words", X.words(F.concat_ws("\n", F.col("text"), F.array_join("ui", "\n"))))
    return listed.where(X.looks_english(F.col("lang"), F.col("body_words")))


# ------------------------------------------------------------------ words inside their row
#: Dictionary words that one step of the scan looks up; more take several steps of the same scan.
BOOK_ROWS = 500_000
#: Words that a task works on at a time; a longer text is a slice by itself.
SLICE_WORDS = 250_000
HIT = "struct<low:string,shown:string,times:long,in_ui:boolean,right:string>"
VARIANT = (
    "struct<first:int,k:int,single:string,single_shown:string,single_times:long,single_ui:boolean,"
    "double:string,double_shown:string,double_times:long,double_ui:boolean>"
)


class _Words:
    """Words of a batch: row i holds ``codes[bounds[i]:bounds[i + 1]]``, numbers of the ``lows``."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, lists = batch, batch.column("lows")
        self.bounds = lists.offsets.to_numpy().astype(np.int64)
        self.bounds -= self.bounds[0]
        coded = lists.flatten().dictionary_encode()
        self.lows, self.codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)

    def rows_with(self, marked: np.ndarray) -> np.ndarray:
        """The rows that hold one of the marked words."""
        return np.unique(np.searchsorted(self.bounds, np.flatnonzero(marked[self.codes]), side="right") - 1)

    def told(self, row: int, wanted: set[int]) -> dict[int, tuple[int, int, str, bool]]:
        """Wanted words of a row in order: number -> first place, times, as first written, in the ui."""
        codes = self.codes[self.bounds[row] : self.bounds[row + 1]]
        shown, ui = self.batch.column("words")[row], set(self.batch.column("ui_words")[row].as_py())
        kinds, first, times = np.unique(codes, return_index=True, return_counts=True)
        out = [(int(f), int(c), int(n)) for c, f, n in zip(kinds, first, times, strict=True) if int(c) in wanted]
        return {c: (f, n, shown[f].as_py(), self.lows[c] in ui) for f, c, n in sorted(out)}

    def with_column(self, name: str, values: list[list], kind: pa.DataType) -> pa.RecordBatch:
        column = pa.array(values, kind)
        if name in self.batch.schema.names:
            return self.batch.set_column(self.batch.schema.get_field_index(name), name, column)
        return self.batch.append_column(name, column)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about SLICE_WORDS words."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("lows")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_WORDS, side="right")))
            # a copy: offsets start at 0 and the slice before can go
            yield batch.take(pa.array(np.arange(start, stop)))
            start = stop


def _look_up(state, kind: pa.DataType, kept: list[str]):
    """Adds the dictionary's words to the ``hits`` of each row; hands on the columns that are ``kept``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = state.value
        for batch in _slices(batches):
            words, hits = _Words(batch), batch.column("hits").to_pylist()
            marked = np.fromiter((w in book for w in words.lows), bool, len(words.lows))
            wanted = set(np.flatnonzero(marked).tolist())
            for row in words.rows_with(marked).tolist():
                for code, (_, times, shown, in_ui) in words.told(row, wanted).items():
                    low = words.lows[code]
                    hits[row].append({"low": low, "shown": shown, "times": times, "in_ui": in_ui, "right": book[low]})
            yield words.with_column("hits", hits, kind).select(kept)

    return task


def single_forms(low: str) -> list[str]:
    """The word with one of its doubled letters written once, for each that may be a slip."""
    if not DOUBLED.fullmatch(low):
        return []
    cuts = [i for i in range(len(low) - 1) if low[i] == low[i + 1] and low[i + 2 :] not in seeds.DOUBLING_SUFFIXES]
    return [low[: i + 1] + low[i + 2 :] for i in cuts]


DOUBLED = re.compile("[a-z]{7,}")


def _vary(kind: pa.DataType, kept: list[str]):
    """Adds the ``variants`` of each row: words with a doubled letter whose single form stands there too;
    hands on the columns that are ``kept``."""
    fine = {frozenset(p) for p in seeds.VALID_SPELLING_PAIRS}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = _Words(batch)
            number = {w: i for i, w in enumerate(words.lows)}
            forms: dict[int, dict[int, int]] = {}
            for w, i in number.items():
                for k, single in enumerate(single_forms(w)):
                    if single in number and frozenset((w, single)) not in fine:
                        forms.setdefault(i, {}).setdefault(number[single], k)
            marked = np.zeros(len(words.lows), bool)
            marked[list(forms)] = True
            wanted = set(forms) | {c for own in forms.values() for c in own}
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for row in words.rows_with(marked).tolist() if forms else ():
                told, wrong = words.told(row, wanted), {h["low"] for h in batch.column("hits")[row].as_py()}
                for double, (first, times, shown, in_ui) in told.items():
                    for single, k in forms.get(double, {}).items():
                        if single in told and not wrong & {words.lows[double], words.lows[single]}:
                            _, n, single_shown, single_ui = told[single]
                            out[row].append({
                                "first": first, "k": k, "single": words.lows[single], "single_shown": single_shown, "single_times": n, "single_ui": single_ui,
                                "double": words.lows[double], "double_shown": shown, "double_times": times, "double_ui": in_ui})
            yield words.with_column("variants", out, kind).select(kept)

    return task


def told_rows(eng: DataFrame, dictionary: DataFrame | None = None, variants: bool = True, kept: tuple[str, ...] = ("text", "ui")) -> DataFrame:
    """The documents with the dictionary words (``hits``) and spelling ``variants`` of each, found inside the row:
    one scan, in which no word leaves its text. The dictionary is broadcast in parts of about BOOK_ROWS words.
    Only doc_id and the ``kept`` columns travel along; the words end with the last step."""
    spark = eng.sparkSession
    lower = lambda words: F.transform(words, lambda w: F.lower(w))
    rows = eng.select(
        "doc_id", *kept, F.col("body_words").alias("words"), lower(F.col("body_words")).alias("lows"),
        lower(X.words(F.array_join("ui", "\n"))).alias("ui_words"), F.expr(f"CAST(array() AS array<{HIT}>)").alias("hits"))
    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(f"hits array<{HIT}>, variants array<{VARIANT}>"))}
    if dictionary is not None:
        book = dictionary.groupBy(F.lower("wrong").alias("low")).agg(F.min("right").alias("right"))
        parts = 1 + book.count() // BOOK_ROWS
        last = ["doc_id", *kept, "hits"]
        for part in range(parts):
            some = {r["low"]: r["right"] for r in book.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == part).collect()}
            names = rows.columns if variants or part < parts - 1 else last
            rows = rows.mapInArrow(_look_up(spark.sparkContext.broadcast(some), kinds["hits"], names), rows.select(*names).schema)
    if variants:
        names = ["doc_id", *kept, "hits"]
        schema = StructType([*rows.select(*names).schema, *StructType.fromDDL(f"variants array<{VARIANT}>")])
        rows = rows.mapInArrow(_vary(kinds["variants"], [*names, "variants"]), schema)
    return rows


def _context(shown: Column) -> Column:
    return let(X.context(F.col("text"), shown), lambda c: F.when(c == "", shown).otherwise(c))


def misspellings(eng: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, low, shown, suggestion, times, in_ui, context; found in the row."""
    hits = told_rows(eng, dictionary, variants=False, kept=("text",)).select("doc_id", "text", F.explode("hits").alias("h"))
    return hits.select(
        "doc_id", "h.low", "h.shown", X.same_case(F.col("h.right"), F.col("h.shown")).alias("suggestion"), "h.times", "h.in_ui",
        _context(F.col("h.shown")).alias("context"),
    )


def phrase_slips() -> Column:
    """The set phrases of a row gone wrong: n (1 forget, 2 modal + of, 3 your welcome), shown, suggestion."""
    forget = F.get(
        F.filter(F.transform("ui", lambda s: collapse(s)), lambda s: s.rlike(r"(?i)^forget\s+(your\s+)?password\s*\??$")), 0
    )
    modal = F.regexp_extract("text", r"(?iU)\b(?:could|should|would|must)\s+of\b(?!\s+course)", 0)
    welcome = F.regexp_extract("text", r"(?imU)\byour\s+welcome(?=\s*[.!]|\s*$)", 0)
    row = lambda n, shown, fix: F.when(
        shown != "", F.struct(F.lit(n).alias("n"), shown.alias("shown"), fix.alias("suggestion"))
    )
    forgot = F.concat(F.when(forget.rlike("^F"), "Forgot").otherwise("forgot"), F.substr(forget, F.lit(7)))
    have = F.concat(F.regexp_extract(modal, r"^(\w+)", 1), F.lit(" have"))
    rows = F.array(row(1, forget, forgot), row(2, modal, have), row(3, welcome, F.lit("you're welcome")))
    return F.filter(rows, lambda r: r.isNotNull())


def wrong_phrases(eng: DataFrame) -> DataFrame:
    """doc_id, n, shown, suggestion of the set phrases gone wrong. Row-wise."""
    return eng.select("doc_id", F.explode(phrase_slips()).alias("p")).select("doc_id", "p.*")


def _variant(v: Column) -> dict[str, Column]:
    """The rarer form of a variant and the commoner one; as often, the single letter is the rare one."""
    single_rare = v["single_times"] <= v["double_times"]
    pick = lambda a, b: F.when(single_rare, v[a]).otherwise(v[b])
    return {
        "rare": pick("single_shown", "double_shown"), "common": pick("double_shown", "single_shown"),
        "rare_times": pick("single_times", "double_times"), "common_times": pick("double_times", "single_times"),
        "rare_in_ui": pick("single_ui", "double_ui"),
    }


def spelling_variants(eng: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Words with a doubled letter whose single form stands in the same text:
    doc_id, first, k, rare, common, rare_times, common_times, rare_in_ui; found in the row."""
    rows = told_rows(eng, dictionary, kept=()).select("doc_id", F.explode("variants").alias("v"))
    return rows.select("doc_id", "v.first", "v.k", *[c.alias(n) for n, c in _variant(F.col("v")).items()])


def _note(flag: Column) -> Column:
    return F.when(flag, UI_NOTE).otherwise("")


def text_findings(docs: DataFrame, dictionary: DataFrame, limit: int | None = None) -> DataFrame:
    """The slips of each text (with ``limit`` only the first ones) as rows (doc_id, place, title, detail, word, suggestion,
    times, context): misspellings (words in menus first, then by letter), phrases, variants. They are found, put in order and
    numbered inside the text's row: one scan and no shuffle."""
    rows = told_rows(english(docs), dictionary)
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))

    def finding(order, title: Column, detail: Column, word: Column, suggestion: Column, times: Column, context: Column) -> Column:
        place = F.struct(*[F.lit(x).alias(n) if not isinstance(x, Column) else x.alias(n) for n, x in zip("abcd", order, strict=True)])
        return F.struct(place.alias("o"), title.alias("title"), detail.alias("detail"), word.alias("word"), suggestion.alias("suggestion"),
                        times.cast("long").alias("times"), context.alias("context"))

    def spelled(h: Column) -> Column:
        right, near = X.same_case(h["right"], h["shown"]), _context(h["shown"])
        title = F.concat(F.lit("Spelling mistake: "), q(h["shown"]), F.lit(" should be "), q(right))
        return finding((1, (~h["in_ui"]).cast("int"), 0, h["low"]), title, F.concat(near, _note(h["in_ui"])), h["shown"], right, h["times"], near)

    def phrased(p: Column) -> Column:
        title = F.concat(F.lit("Wrong phrase: "), q(p["shown"]), F.lit(" should be "), q(p["suggestion"]))
        return finding((2, p["n"], 0, ""), title, F.lit("A common slip."), p["shown"], p["suggestion"], F.lit(1), _context(p["shown"]))

    def varied(v: Column) -> Column:
        c = _variant(v)
        title = F.concat(F.lit("Same word spelled two ways: "), q(c["rare"]), F.lit(" and "), q(c["common"]))
        detail = F.concat(c["rare_times"], F.lit("× and "), c["common_times"], F.lit("×."), _note(c["rare_in_ui"]))
        return finding((3, v["first"], v["k"], ""), title, detail, c["rare"], c["common"], c["rare_times"], _context(c["rare"]))

    slips = F.array_sort(F.concat(F.transform("hits", spelled), F.transform(phrase_slips(), phrased), F.transform("variants", varied)))
    placed = rows.select("doc_id", F.posexplode(slips if limit is None else F.slice(slips, 1, limit)).alias("at", "f"))
    return placed.select("doc_id", (F.col("at") + 1).alias("place"), "f.title", "f.detail", "f.word", "f.suggestion", "f.times", "f.context")
