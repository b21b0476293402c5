"""Quality rules: cross-document line frequency on top of per-document word statistics.

A line is normalised (A-Z lowered, digits to 0, runs of white space to one space, ends
trimmed) and hashed. For every host the distinct documents that hold it are counted;
lines above ``max_docs`` are boilerplate and leave the text; a document that keeps less
than ``min_left`` percent of its words is rejected as depleted.

Documents count by content: a document's identity is the hash of its whole text, so that
a page crawled a thousand times counts once and is not mistaken for a thousand pages that
share a footer. Texts that differ anywhere are documents of their own.

Defined cases: a null or empty text, or one of white space, has no words and fails
``n_words < min_words``; blank lines have no hash; a null host is a host of its own;
repeated rows are judged one by one and get equal results; columns of any other name
are ignored, and names of the result are taken only by the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrow_text import MIX, mix, slices, split_words, window_hashes, window_starts
from webloom.llm.stages import Stages
from webloom.session import broadcast_if_small

MAX_DOCS = 100
MIN_LEFT = 30
MIN_WORDS = 10
REPEAT_WIDTH = 5
MAX_REPEAT = 20

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<binary>, line_words array<int>"
)


def normal_lines(lines: pa.Array) -> pa.Array:
    """Lines as they are compared across documents."""
    out = pc.replace_substring_regex(pc.ascii_lower(lines), "[0-9]", "0")
    return pc.ascii_trim(pc.replace_substring_regex(out, "[\\x09-\\x0d\\x20]+", " "), " ")


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


def text_stats(texts: pa.Array) -> dict[str, pa.Array]:
    """The columns of STATS for a batch of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, "\n")
    line_offsets = lists.offsets.to_numpy().astype(np.int64)
    line_offsets = line_offsets - line_offsets[0]
    lines = lists.flatten()
    words = split_words(lines)
    doc_offsets = words.offsets[line_offsets]
    n_words = np.diff(doc_offsets)
    lengths = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = per_document(lengths[words.codes], doc_offsets)

    owner = np.repeat(np.arange(len(n_words)), np.diff(line_offsets))
    coded = lines.dictionary_encode()
    line_codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = words.counts > 0
    place = owner[full] * (len(coded.dictionary) + 1) + line_codes[full]
    first = np.unique(place)
    n_full = np.bincount(owner[full], minlength=len(n_words))
    n_dup = n_full - np.bincount(first // (len(coded.dictionary) + 1), minlength=len(n_words))

    total = len(words.codes)
    covered = np.zeros(total, bool)
    if total >= REPEAT_WIDTH:
        runs = window_hashes(mix(words.codes.astype(np.uint64) + MIX), REPEAT_WIDTH)
        doc_of = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)[: len(runs)]
        starts = np.flatnonzero(window_starts(doc_offsets, REPEAT_WIDTH, total)[: len(runs)])
        keys = mix(runs[starts] + doc_of[starts] * MIX)
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = starts[counts[inverse] > 1]
        marks = np.zeros(total + 1, np.int64)
        np.add.at(marks, again, 1)
        np.add.at(marks, again + REPEAT_WIDTH, -1)
        covered = np.cumsum(marks[:total]) > 0

    md5 = hashlib.md5
    digests = [md5(s.encode(), usedforsecurity=False).digest() if s else None for s in normal_lines(coded.dictionary).to_pylist()]
    picked = pa.array(digests, pa.binary()).take(pa.array(line_codes[full]))
    ends = pa.array(np.concatenate(([0], np.cumsum(n_full))).astype(np.int32))
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "word_chars": pa.array(word_chars, pa.int64()),
        "n_symbols": pc.fill_null(pc.count_substring_regex(texts, "[#*$%&|<>]"), 0).cast(pa.int64()),
        "n_dup_lines": pa.array(n_dup.astype(np.int64)),
        "n_repeat_words": pa.array(per_document(covered, doc_offsets), pa.int64()),
        "lines": pa.ListArray.from_arrays(ends, picked),
        "line_words": pa.ListArray.from_arrays(ends, pa.array(words.counts[full].astype(np.int32))),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        kept = {n: part.column(n) for n in part.schema.names if n != "text"}
        yield pa.RecordBatch.from_pydict(kept | text_stats(part.column("text")))


def measured(docs: DataFrame, host: str, stages: Stages) -> DataFrame:
    """One written row per document: a row number, the host, the hash of its text, its statistics and its line hashes."""
    some = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("content"), "text")
    schema = f"doc_id {some.schema['doc_id'].dataType.simpleString()}, host string, content long, {STATS}"
    return stages.write(some.mapInArrow(_measure, schema).withColumn("row", F.monotonically_increasing_id()), "stats")


def frequent_lines(rows: DataFrame, max_docs: int) -> DataFrame:
    """(host, line, n_docs) of the lines that more than ``max_docs`` different texts of a host hold.
    Both steps aggregate before they shuffle, so one line or host never meets in one task."""
    each = rows.select("host", "content", F.explode(F.array_distinct("lines")).alias("line"))
    return (
        each.groupBy("host", "line", "content").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.sum("one").cast("long").alias("n_docs")).where(F.col("n_docs") > max_docs)
    )


def line_quality(
    docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT, gone: bool = False
) -> DataFrame:
    """The verdict on every document: statistics, base_failed, n_frequent_lines, words_left, kept;
    with ``gone`` also the hashes of the frequent lines that the document holds."""
    stages = Stages(docs.sparkSession, "quality")
    rows = measured(docs, host, stages)
    frequent = stages.write(frequent_lines(rows, max_docs).select("host", "line"), "frequent")
    places = rows.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("at"))
    places = places.select("row", F.col("host").alias("h"), F.col("at.lines").alias("l"), F.col("at.line_words").alias("w"))
    hit = places.join(broadcast_if_small(frequent), F.col("h").eqNullSafe(F.col("host")) & (F.col("l") == F.col("line")))
    lines = hit.groupBy("row").agg(
        F.count("*").alias("n_gone"), F.sum("w").alias("w_gone"), *([F.collect_set("l").alias("gone")] if gone else []))
    out = rows.join(lines, "row", "left")
    left = F.col("n_words") - F.coalesce("w_gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * left >= min_left * F.col("n_words"))).alias("kept"),
        F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_frequent_lines"), left.cast("long").alias("words_left"),
        *(["gone"] if gone else []),
    )


def cleaned(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in texts without frequent lines
    (and ``n_chars`` counted anew where there is such a column)."""
    key = F.xxhash64("doc_id", F.col(host).cast("string"), "text")
    stages = Stages(docs.sparkSession, "cleaned")
    verdicts = line_quality(docs.withColumn("doc_id", key), host, max_docs, min_left, gone=True)
    # equal rows have equal verdicts
    verdicts = verdicts.where("kept").select(F.col("doc_id").alias("quality_key"), "gone")
    verdicts = stages.write(verdicts.groupBy("quality_key").agg(F.max("gone").alias("gone_lines")), "verdicts")
    rows = docs.withColumn("quality_key", key).join(verdicts, "quality_key").drop("quality_key")
    schema = docs.schema
    return rows.mapInArrow(_without_lines, schema)


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        names = [n for n in part.schema.names if n != "gone_lines"]
        texts, gone = part.column("text").to_pylist(), part.column("gone_lines").to_pylist()
        clean = [t if not g else strip_lines(t, set(g)) for t, g in zip(texts, gone, strict=True)]
        columns = {n: part.column(n) for n in names} | {"text": pa.array(clean, pa.string())}
        if "n_chars" in columns:
            columns["n_chars"] = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
        yield pa.RecordBatch.from_pydict(columns)


def strip_lines(text: str, gone: set[bytes]) -> str:
    lines = text.split("\n")
    keys = normal_lines(pa.array(lines, pa.large_string())).to_pylist()
    return "\n".join(a for a, k in zip(lines, keys, strict=True) if not k or hashlib.md5(k.encode(), usedforsecurity=False).digest() not in gone)
