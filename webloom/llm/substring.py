"""Substring dedup by seed and extend.

Seeds. Every run of ``LENGTH`` words is represented by the smallest hash among the
``SEED``-word runs inside it, its winnowed anchor. The anchor depends on the words of the
run alone, so two equal runs have equal anchors: a run can only repeat if its anchor occurs
at least twice. Anchors are about one in ten words; they are counted with partial sums.

Extend. Around the anchors that repeat, and only there, matches are extended over both
sides, run by run of the required length, by 64-bit hashes. A run whose hash occurs once is
an end of a match; such runs are found by one aggregate that keeps their place (a count of
one has one place), so nothing is joined with itself and a passage in a third of all
documents costs one row per occurrence. What remains are the maximal repeats: unions of
overlapping repeated runs.

Defined cases: null, empty and short texts have no run and keep their words; each row is a
document, so repeated rows repeat each other; the anchor of a run with ties is the same
hash wherever it stands; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrow_text import Words, list_array, signed, slices, split_words, string_hashes, window_hashes, window_starts
from webloom.llm.stages import Stages

LENGTH = 35
SEED = 17


def slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def runs_of(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors, places, marks): where runs of ``length`` words start, the anchor hash
    of each, and the places and hashes of all anchors."""
    total = len(words.codes)
    none = np.zeros(0, np.int64)
    if total < length:
        return none, none.view(np.uint64), none, none.view(np.uint64)
    hashes = string_hashes(words.dictionary)[words.codes]
    seeds = window_hashes(hashes, seed, seed=7)
    width = length - seed + 1
    least = slide(seeds, width, np.minimum)
    inside = window_starts(words.offsets, length, total)[: len(least)]
    starts = np.flatnonzero(inside)
    # a place is an anchor if a run over it has its hash as smallest
    seen = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    seen[width - 1 : width - 1 + len(least)] = np.where(inside, least, 0)
    most = slide(seen, width, np.maximum)
    places = np.flatnonzero((most[: len(seeds)] == seeds) & (most[: len(seeds)] > 0))
    return starts, least[starts], places, seeds[places]


def sha_of_words(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def kept_words(words: Words, doc: int, keep: np.ndarray | None = None) -> list[str]:
    codes = words.codes[words.offsets[doc] : words.offsets[doc + 1]]
    return words.dictionary.take(pa.array(codes if keep is None else codes[keep])).to_pylist()


def _seed(length: int, seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split_words(part.column("text"))
            _, _, places, marks = runs_of(words, length, seed)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "key": part.column("key"), "n_words": pa.array(words.counts, pa.int64()),
                "kept_sha256": pa.array([sha_of_words(kept_words(words, d)) for d in range(part.num_rows)]),
                "seeds": list_array(signed(marks), np.searchsorted(places, words.offsets)),
            })

    return task


def _known(part: pa.RecordBatch, anchors: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where the anchor of a run is among the repeated anchors of its document."""
    out = np.zeros(len(anchors), bool)
    lists = part.column("seeds")
    bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
    for d in range(part.num_rows):
        a, b = bounds[d], bounds[d + 1]
        if b > a:
            out[a:b] = np.isin(anchors[a:b], np.asarray(lists[d].as_py(), np.int64).view(np.uint64))
    return out


def _extend(length: int, seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split_words(part.column("text"))
            starts, anchors, _, _ = runs_of(words, length, seed)
            owner = words.owners()[starts]
            good = _known(part, anchors, owner)
            starts, owner = starts[good], owner[good]
            whole = window_hashes(string_hashes(words.dictionary)[words.codes], length, seed=11)[starts] if len(starts) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({
                "run": pa.array(signed(whole)), "key": part.column("key").take(pa.array(owner)), "at": pa.array(starts - words.offsets[owner], pa.int64())})

    return task


def _cut(length: int, seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split_words(part.column("text"))
            starts, anchors, _, _ = runs_of(words, length, seed)
            owner = words.owners()[starts]
            good = _known(part, anchors, owner)
            marks = np.zeros(len(words.codes) + 1, np.int64)
            ends = part.column("ends").to_pylist()
            single = np.zeros(len(words.codes) + 1, bool)
            for d, list_ in enumerate(ends):
                if list_:
                    single[words.offsets[d] + np.asarray(list_, np.int64)] = True
            again = starts[good & ~single[starts]] if len(starts) else starts
            np.add.at(marks, again, 1)
            np.add.at(marks, again + length, -1)
            keep = np.cumsum(marks)[:-1] == 0
            rows = [keep[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
            kept = [kept_words(words, d, k) for d, k in enumerate(rows)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array([int((~k).sum()) for k in rows], pa.int64()),
                "kept_sha256": pa.array([sha_of_words(k) for k in kept]),
                "kept_text": pa.array([" ".join(k) for k in kept]),
            })

    return task


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = False) -> DataFrame:
    """Every document without the words that a repeated run of ``length`` words covers:
    doc_id, n_words, n_removed, kept_sha256; with ``texts`` also ``kept_text``, null where
    nothing was removed."""
    stages = Stages(docs.sparkSession, "substring")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    seeded = stages.write(
        rows.mapInArrow(_seed(length, seed), f"doc_id {kind}, key long, n_words long, kept_sha256 string, seeds array<long>"), "seeded")
    places = seeded.select("key", F.explode("seeds").alias("seed"))
    again = places.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    hits = places.join(again, "seed", "left_semi").groupBy("key").agg(F.collect_set("seed").alias("seeds"))
    hit = stages.write(rows.join(hits, "key"), "hit")
    runs = hit.select("text", "key", "seeds").mapInArrow(_extend(length, seed), "run long, key long, at long")
    alone = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("at").alias("at")).where("n = 1")
    ends = alone.groupBy("key").agg(F.collect_list("at").alias("ends"))
    cut = hit.join(ends, "key", "left").select("doc_id", "text", "seeds", "ends")
    cut = cut.mapInArrow(_cut(length, seed), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    rest = seeded.join(hit.select("key").distinct(), "key", "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    out = cut.unionByName(rest)
    return out if texts else out.drop("kept_text")
