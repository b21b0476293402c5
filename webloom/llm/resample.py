"""Importance resampling towards a target distribution, with distinct lines counted once.

Features of a text are its runs of 1 to ``max_n`` consecutive words (A-Z lowered; words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), hashed into ``buckets``. New lines are no part of a
word, so they cut a text into lines without cutting a word. The lines of a slice of texts are
made distinct; the features of a distinct line are found, hashed and summed once and count as often as
the line occurs; runs of words over a line's end are added separately, from the words around it. The
first pass gives the bucket counts of the corpus and of the target, the second the weight of
each document, again from the distinct lines' weights. Neither pass shuffles a text: a task sends one row
per bucket at most, and the table of gains has ``buckets`` rows whatever the data are.

A document's score is its weight plus noise drawn from a hash of its id; of the documents with
at least ``min_words`` words the ``percent`` with the highest scores are drawn. Ranks come from a range
partitioning by (score, doc_id): a row's rank is its place in its partition plus the sizes of the
partitions before it, so no task sees more than its share.

Defined cases: a null or empty text has no features and weight 0; a null doc_id draws its noise as an
empty id does and ranks after others of its score; repeated rows are scored and drawn one by one; an empty
corpus gives no rows; an empty target leaves all gains to the corpus counts; texts are read
whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.arrow_text import slices, split_words
from webloom.llm.stages import Stages

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of text whose lines are made distinct together.
BYTES = 16 << 20

#: Bytes as words see them: A-Z lowered, all ASCII but letters and digits a space.
SEEN = np.arange(256, dtype=np.uint8)
SEEN[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]


def plain_words(texts: pa.Array) -> pa.Array:
    """The texts with single-byte characters outside of words turned into spaces; UTF-8 stays whole."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    seen = SEEN[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(seen), offset=texts.offset)


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


class LineFeatures:
    """Features of a batch of texts: those of its distinct lines, and those over line ends.

    Text d has the lines ``codes[bounds[d]:bounds[d + 1]]``; line c the features
    ``line_buckets[line_offsets[c]:line_offsets[c + 1]]``; the features of text d over line ends are
    ``cross_buckets[cross_offsets[d]:cross_offsets[d + 1]]``.
    """

    def __init__(self, texts: pa.Array, max_n: int, buckets: int):
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        self.bounds = lists.offsets.to_numpy().astype(np.int64)
        self.bounds -= self.bounds[0]
        lines = lists.flatten().dictionary_encode()
        self.codes = lines.indices.to_numpy(zero_copy_only=False)
        self.buckets = buckets
        self.words = split_words(plain_words(lines.dictionary))
        self.line_words = self.words.counts
        owners = self.words.owners()
        found = [self.runs(self.words.codes, owners, n) for n in range(1, max_n + 1)]
        self.line_buckets, self.line_offsets = self.joined(found, len(self.line_words))
        over = [self.over_ends(n) for n in range(2, max_n + 1)]
        self.cross_buckets, self.cross_offsets = self.joined(over, len(texts))

    @staticmethod
    def joined(parts: list[tuple[np.ndarray, np.ndarray]], owners: int) -> tuple[np.ndarray, np.ndarray]:
        """(owner, bucket) pairs as buckets in the order of their owners, and the owners' bounds."""
        owner = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        bucket = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        if len(parts) > 1:
            order = np.argsort(owner, kind="stable")
            owner, bucket = owner[order], bucket[order]
        return bucket, np.searchsorted(owner, np.arange(owners + 1))

    def hashed(self, strings: pa.Array) -> np.ndarray:
        return np.fromiter((zlib.crc32(s.encode()) % self.buckets for s in strings.to_pylist()), np.int64, len(strings))

    def run_buckets(self, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Buckets of the runs of n words from the places ``starts``; each distinct run is hashed once."""
        if n == 1:
            return self.hashed(self.words.dictionary)[words[starts]]
        text = [self.words.dictionary.take(pa.array(words[starts + i])) for i in range(n)]
        runs = pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string())).dictionary_encode()
        return self.hashed(runs.dictionary)[runs.indices.to_numpy(zero_copy_only=False)]

    def runs(self, words: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(owner, bucket) of the runs of n words inside an owner."""
        last = max(len(words) - n + 1, 0)
        starts = np.flatnonzero(owners[:last] == owners[n - 1 :]) if last else np.zeros(0, np.int64)
        return owners[starts], self.run_buckets(words, starts, n)

    def over_ends(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of the runs of n words in a text that leave the line they start in."""
        sizes = self.line_words[self.codes]
        line = np.repeat(np.arange(len(self.codes)), sizes)
        place = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words = self.words.codes[self.words.offsets[self.codes[line]] + place] if len(line) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[line] if len(line) else line
        last = max(len(words) - n + 1, 0)
        starts = np.flatnonzero((text[:last] == text[n - 1 :]) & (line[:last] != line[n - 1 :])) if last else np.zeros(0, np.int64)
        return text[starts], self.run_buckets(words, starts, n)

    def counts(self) -> np.ndarray:
        """Features per bucket in all texts: a distinct line's features times its occurrences."""
        times = np.bincount(self.codes, minlength=len(self.line_words))
        of_lines = np.bincount(self.line_buckets, weights=np.repeat(times, np.diff(self.line_offsets)), minlength=self.buckets)
        return of_lines.astype(np.int64) + np.bincount(self.cross_buckets, minlength=self.buckets)

    def per_text(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, features, sum of gains) of each text."""
        of_line = summed(gains[self.line_buckets], self.line_offsets)
        n_line = np.diff(self.line_offsets)
        weights = summed(of_line[self.codes], self.bounds) + summed(gains[self.cross_buckets], self.cross_offsets)
        return summed(self.line_words[self.codes], self.bounds), summed(n_line[self.codes], self.bounds) + np.diff(self.cross_offsets), weights


def _count(max_n: int, buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, size=BYTES):
            total += LineFeatures(part.column("text"), max_n, buckets).counts()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some])})

    return task


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; at most ``buckets`` rows reach the driver."""
    rows = texts.select("text").mapInArrow(_count(max_n, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the corpus' share), add-one in every bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(state, max_n: int, buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = state.value
        for part in slices(batches, size=BYTES):
            words, features, weights = LineFeatures(part.column("text"), max_n, buckets).per_text(gains)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(weights)})

    return task


def noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 times Gumbel noise) from the first 32 bits of the id's digest."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, drawn: int, stages: Stages, label: str = "ordered") -> DataFrame:
    """``rows`` (doc_id, score, ...) with ``rank`` 1, 2, 3 ... by score descending, doc_id for the first ``drawn``."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = stages.write(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)
    sizes = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())  # one row per partition
    before, total = [], 0
    for part, n in sizes:
        if total < drawn:
            before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    with_drawn = parts.join(F.broadcast(offsets), "part")
    without = parts.join(F.broadcast(offsets), "part", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    rank = F.col("before") + place
    some = with_drawn.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("before")
    return some.unionByName(without).drop("part")


def resample(
    docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): n_features, weight, score and, for the drawn ones, rank.
    ``target`` has the texts (text) whose distribution is wanted."""
    stages = Stages(docs.sparkSession, "resample")
    gains = bucket_gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    state = docs.sparkSession.sparkContext.broadcast(gains)
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(_weigh(state, max_n, buckets), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = stages.write(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    long_enough = F.col("n_words") >= min_words
    drawn = scored.where(long_enough).count() * percent // 100
    out = ranked(scored.where(long_enough), drawn, stages)
    short = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The documents that are drawn, with all their columns (doc_id names one document)."""
    chosen = resample(docs, target, **parameters).where(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi").select(*docs.columns)
