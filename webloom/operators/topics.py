"""Topic terms in texts: hits, the page gate."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import topic_norm
from webloom.functions.urls import let

#: Characters of the terms that one automaton holds; more terms take several automata.
BLOCK_CHARS = 1_000_000


def term_list(terms: Iterable[str]) -> list[str]:
    """Terms in normal form, empty ones dropped, shortest first."""
    out = {re.sub(r"[^a-z0-9]+", " ", t.lower()).strip() for t in terms}
    return sorted(out - {""}, key=lambda t: (len(t), t))


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    if len(out):
        out.make_automaton()
    return out


def found_in(known: ahocorasick.Automaton, text: str) -> set[str]:
    """The terms that stand anywhere in a text, in one pass over it."""
    return {t for _, t in known.iter(text)} if len(known) else set()


def minimal_terms(terms: Iterable[str]) -> list[str]:
    """The terms that count: a term that contains another never does, as a text that
    holds it holds the other one too."""
    ordered = term_list(terms)
    known = automaton(ordered)
    return [t for t in ordered if found_in(known, t) == {t}]


def topic_hit_terms(text: Column, terms: Iterable[str]) -> Column:
    """Terms found in the text, without those that contain another found term; for a few terms."""
    few = minimal_terms(terms)
    ordered = F.array(*[F.lit(t) for t in few]) if few else F.array().cast("array<string>")
    return let(topic_norm(text), lambda hay: F.filter(ordered, lambda t: hay.contains(t)))


def _blocks(words: DataFrame) -> Iterator[list[str]]:
    """The terms in parts of about BLOCK_CHARS characters, by hash."""
    chars = words.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    n = 1 + chars // BLOCK_CHARS
    for b in range(n):
        yield [r["term"] for r in words.where(F.pmod(F.xxhash64("term"), F.lit(n)) == b).collect()]


def _search(state):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(state.value)
        for batch in batches:
            owners, hits = [], []
            for i, hay in enumerate(batch.column("hay").to_pylist()):
                some = found_in(known, hay)
                owners.extend([i] * len(some))
                hits.extend(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int32())), pa.array(hits, pa.string())], [batch.schema.names[0], "term"])

    return task


def _hits(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(first column, term) of ``rows`` (key, hay): one scan for each automaton, nothing is shuffled."""
    spark: SparkSession = rows.sparkSession
    key = rows.schema[0]
    out = None
    for block in _blocks(words):
        state = spark.sparkContext.broadcast(block)
        one = rows.mapInArrow(_search(state), f"`{key.name}` {key.dataType.simpleString()}, term string")
        out = one if out is None else out.unionAll(one)
    return out


def minimal_table(terms: DataFrame) -> DataFrame:
    """Distinct normal terms (term) of a table of any size, without those that contain another."""
    words = terms.select(F.trim(topic_norm("term")).alias("term")).where("term <> ''").distinct()
    longer = _hits(words.select("term", F.col("term").alias("hay")).toDF("own", "hay"), words).where("own <> term")
    return words.join(longer.select(F.col("own").alias("term")).distinct(), "term", "left_anti")


def topic_hits(docs: DataFrame, terms, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term) rows: the terms found in each row of ``docs``, without those that contain another
    found one. ``terms`` is a list or a table (term) of any size. Texts are read where they lie, each
    once by an automaton of all terms (or of each block of them); only hits leave the tasks."""
    if not isinstance(terms, DataFrame):
        terms = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    rows = docs.select(F.col(key), topic_norm(F.col(text)).alias("hay"))
    return _hits(rows, minimal_table(terms))


def topic_match(docs: DataFrame, terms: list[str], min_hits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hits, on_topic); without terms everything is on topic."""
    hits = F.size(topic_hit_terms(F.col(text), terms))
    on = hits >= max(1, min_hits) if term_list(terms) else F.lit(True)
    return docs.select(key, hits.alias("hits"), on.alias("on_topic"))


def page_topic_gate(
    pages: DataFrame, terms: list[str], min_hits: int = 2, sample_chars: int | None = None
) -> DataFrame:
    """Judge captured pages (page_id, url, title, body): thin | on topic | off topic.
    A page that shows almost no text is not judged. The whole body is read unless
    ``sample_chars`` asks for less."""
    body = F.trim("body" if sample_chars is None else F.left("body", F.lit(sample_chars)))
    sample = F.concat_ws(" ", "title", "url", body)
    hits = F.size(topic_hit_terms(sample, terms))
    verdict = (
        F.when(F.length(body) < 60, "thin").when(hits >= max(1, min_hits), "on topic").otherwise("off topic")
        if term_list(terms)
        else F.lit("on topic")
    )
    return pages.select("page_id", verdict.alias("verdict"))
