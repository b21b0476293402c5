"""Phrase collocations: frequent runs of words, counted by a multikey quicksort of suffix pointers.

Texts (A-Z lowered) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``; every word of a piece starts a suffix of at most ``MAX_LEN`` words. All
counts are per language (null: ``und``).

1. One scan counts the words, made distinct in their task first.
2. Words of ``min_count`` and more set a bit in a table of fixed size (``BITS``), which is broadcast;
   a second scan cuts every suffix at the first word whose bit is not set. A shared bit only lets a rare
   word through, which step 4 counts exactly. Suffixes are made distinct per slice, with their counts, and
   travel as lists, one for each leading word; the lists of a slice for one part go as one compressed block.
3. The part of a suffix follows from its language and leading word. Words that have more than one of ``HOT_SHARE`` places of the corpus
   (so there are at most ``HOT_SHARE`` of them, whatever the data) are spread by their leading three words.
4. A task sorts its suffix pointers by a three-way multikey quicksort down to ``MAX_LEN`` words. The weight of an
   equal partition is the count of its words; a partition lighter than ``min_count`` is abandoned. Where a task
   sees only a share of the suffixes (pairs of hot words, or more suffixes than ``CHUNK`` at a time) all its
   partitions are handed on. Sums of the shares are the counts.

A phrase is then cut after each of its words; the parts' counts come from joins on the tables of words
and phrases, salted so that a frequent part is no hot key. Arithmetic is in decimals of 38 digits, exact up to
10^15 words per language. A phrase goes when a phrase one word longer is as frequent: a longer one still
would have such a phrase inside it.

Defined cases: a null or empty text has no pieces; a null language is ``und``; repeated rows count
each; an empty table gives no rows; words and texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.arrow_text import MIX, mix, signed, slices, split_words, string_hashes
from webloom.llm.stages import Stages
from webloom.session import shuffle_width

MAX_LEN = 5
MIN_COUNT = 100
TOP = 2000
#: Bits of each broadcast table (8 MB).
BITS = 1 << 26
#: Bits of one row of a table on its way.
BLOCK = 1 << 16
#: A word with more than one of so many places is hot.
HOT_SHARE = 1024
#: Places whose suffixes one task sorts, about, and the most suffixes it sorts at a time.
TASK_PLACES = 2_000_000
CHUNK = 3_000_000
#: Distinct words a task keeps to add up the counts of its slices.
KEPT_ROWS = 150_000
SALTS = 16
#: Bytes of text whose words and suffixes are made distinct together.
BYTES = 6 << 20
#: Ends a piece among the words; no word holds it.
BREAK = "."


# --- words, pairs and suffixes of a slice ------------------------------------------


class Pieces:
    """Words of a slice of texts: ``codes`` with -1 at the end of each piece, ``lang`` the number of a
    word's language in ``langs``, ``dictionary`` the words."""

    def __init__(self, part: pa.RecordBatch):
        low = pc.ascii_lower(pc.fill_null(part.column("text").cast(pa.large_string()), ""))
        words = split_words(pc.replace_substring_regex(low, r"[.,;:!?\x0A-\x0D]+", f" {BREAK} "))
        self.dictionary = words.dictionary
        codes = words.codes.astype(np.int64)
        stop = pc.index(self.dictionary, pa.scalar(BREAK, self.dictionary.type)).as_py()
        if stop >= 0:
            codes[codes == stop] = -1
        langs = pc.fill_null(part.column("lang").cast(pa.string()), "und").dictionary_encode()
        self.langs = langs.dictionary
        # an end after each text as well
        self.codes = np.insert(codes, words.offsets[1:], -1)
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.counts + 1)
        self.kinds = max(len(self.dictionary), 1)

    def ranked(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, their first places, counts)."""
        return np.unique(keys, return_index=True, return_counts=True)

    def word_counts(self) -> pa.RecordBatch:
        live = np.flatnonzero(self.codes >= 0)
        keys, _, n = self.ranked(self.lang[live] * self.kinds + self.codes[live])
        return pa.RecordBatch.from_pydict({
            "lang": self.langs.take(pa.array(keys // self.kinds)), "phrase": self.dictionary.take(pa.array(keys % self.kinds)).cast(pa.string()), "n": pa.array(n)})

    def suffixes(self, frequent: np.ndarray, hot: np.ndarray, parts: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """Distinct suffixes of two words and more with their counts, cut at the first rare word: a row
        has the continuations (rests, one a line) of a leading word. Rows are in the order of their
        parts; part p has the rows from place p of the array on."""
        words, langs = string_hashes(self.dictionary), string_hashes(self.langs)
        live = np.flatnonzero(self.codes >= 0)
        names = np.zeros(len(self.codes), np.uint64)
        names[live] = mix(langs[self.lang[live]] * MIX + words[self.codes[live]])
        often = np.zeros(len(self.codes) + MAX_LEN, bool)
        often[live] = is_set(frequent, place_of(names[live]))
        padded = np.concatenate((self.codes, np.full(MAX_LEN, -1)))
        at = np.flatnonzero(often[:-1] & often[1:])
        rank = self.lang[at] * self.kinds + self.codes[at]
        size, going = np.ones(len(at), np.int64), np.ones(len(at), bool)
        for i in range(1, MAX_LEN):
            going &= often[at + i]
            size += going
            # the rank of a run is that of the run before it and the next word, none where it has ended
            seen = np.unique(rank, return_inverse=True)[1]
            rank = seen * (self.kinds + 1) + np.where(going, padded[at + i], self.kinds)
        _, first, n = self.ranked(rank)
        at, size = at[first], size[first]
        spread, part = np.isin(names[at], hot), names[at]
        far = np.flatnonzero(spread)
        third = np.where(size[far] > 2, padded[at[far] + 2], -1)
        part[far] = mix(mix(part[far] * MIX + words[padded[at[far] + 1]]) * MIX + np.where(third >= 0, words[third], np.uint64(7)))
        part = (part % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # words stay together inside a part
        at, size, n, spread, part = (x[order] for x in (at, size, n, spread, part))
        group = (part * len(self.langs) + self.lang[at]) * self.kinds + self.codes[at]
        rest = size - 1
        within = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
        tokens = self.dictionary.cast(pa.string()).take(pa.array(self.codes[np.repeat(at + 1, rest) + within]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rest))).astype(np.int32)), tokens), " ")
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(heads, len(group)).astype(np.int32)
        head = at[heads]
        lists = pa.RecordBatch.from_pydict({
            "lang": self.langs.take(pa.array(self.lang[head])), "word": self.dictionary.cast(pa.string()).take(pa.array(self.codes[head])),
            "spread": pa.array(spread[heads]), "rests": pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), joined), "\n"),
            "ns": pa.ListArray.from_arrays(pa.array(ends), pa.array(n, pa.int32()))})
        return lists, np.searchsorted(part[heads], np.arange(parts + 1))


def packed(lists: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, lists.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(lists)
    return sink.getvalue().to_pybytes()


def place_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BITS - 1)).astype(np.int64)


def is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def added_up(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []
    for part in slices(batches, size=BYTES):
        kept.append(Pieces(part).word_counts())
        if sum(b.num_rows for b in kept) > 2 * KEPT_ROWS:
            sums = added_up(kept)
            kept = sums.to_batches()
            if sums.num_rows > KEPT_ROWS:
                yield from kept
                kept = []
    if kept:
        yield from added_up(kept).to_batches()


def _cut(state, parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = state.value
        for part in slices(batches, size=BYTES):
            lists, bounds = Pieces(part).suffixes(frequent, hot, parts)
            some = np.flatnonzero(np.diff(bounds))
            # a copy: a slice would be written with the buffers of all rows
            blocks = [packed(lists.take(pa.array(np.arange(bounds[p], bounds[p + 1])))) for p in some.tolist()]
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return task


def name_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    return mix(string_hashes(langs) * MIX + string_hashes(words))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"name": pa.array(signed(name_hashes(batch.column("lang"), batch.column("phrase"))))})


def _pack(block: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(BLOCK // 8, np.uint8)
    place = block["place"].to_numpy()
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return pd.DataFrame({"block": block["block"].iloc[:1], "bits": [bits.tobytes()]})


def bit_table(names: DataFrame) -> np.ndarray:
    """A table of BITS bits with those of ``names`` (lang, phrase) set. Groups have at most BLOCK rows,
    and at most BITS / 8 bytes reach the driver."""
    bit = F.col("name").bitwiseAND(F.lit(BITS - 1).cast("long"))
    named = names.select("lang", "phrase").mapInArrow(_names, "name long")
    places = named.select(F.shiftright(bit, 16).cast("int").alias("block"), bit.bitwiseAND(F.lit(BLOCK - 1).cast("long")).cast("int").alias("place")).distinct()
    out = np.zeros(BITS // 8, np.uint8)
    for r in places.groupBy("block").applyInPandas(_pack, "block int, bits binary").collect():
        out[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


# --- counting by sorting -------------------------------------------------------------


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, depth, weight) of the partitions of rows that agree in their first ``depth`` columns, by a
    three-way multikey quicksort of row pointers. -1 ends a row. A partition lighter than ``least`` is
    abandoned; of the ``shared`` rows not before they agree in three columns, as others have rows like them."""
    out: list[tuple[int, int, int]] = []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        rows, depth = stack.pop()
        column = keys[rows, depth]
        pivot = column[len(rows) // 2]
        below, above = column < pivot, column > pivot
        parts = [(rows[below], depth), (rows[above], depth)]
        if pivot >= 0:
            equal = rows[~(below | above)]
            weight = int(weights[equal].sum())
            if weight >= least or (depth < 3 and shared[equal].any()):
                out.append((int(equal[0]), depth + 1, weight))
                if depth + 1 < keys.shape[1]:
                    parts.append((equal, depth + 1))
        for some, d in parts:
            if len(some) and (weights[some].sum() >= least or (d < 3 and shared[some].any())):
                stack.append((some, d))
    return out


def sorted_lists(lists: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that start the suffixes of some lists."""
    rests = pc.split_pattern(lists.column("rests").combine_chunks(), "\n")
    owner = np.repeat(np.arange(lists.num_rows), np.diff(rests.offsets.to_numpy()))
    tokens = pc.split_pattern(rests.flatten(), " ")
    sizes = np.diff(tokens.offsets.to_numpy())
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    coded = tokens.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    langs, heads = (lists.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word"))
    keys = np.full((len(owner), 1 + MAX_LEN), -1, np.int32)
    keys[:, 0] = langs.indices.to_numpy(zero_copy_only=False)[owner]
    keys[:, 1] = heads.indices.to_numpy(zero_copy_only=False)[owner]
    keys[np.repeat(np.arange(len(owner)), sizes), 2 + np.arange(len(codes)) - np.repeat(starts, sizes)] = codes
    weights = lists.column("ns").combine_chunks().flatten().to_numpy().astype(np.int64)
    shared = lists.column("spread").to_numpy()[owner]
    found = [f for f in equal_partitions(keys, weights, least, shared) if f[1] > 2]
    names, firsts, words = langs.dictionary.to_pylist(), heads.dictionary.to_pylist(), coded.dictionary.to_pylist()
    for a in range(0, len(found), 1 << 16):
        some = found[a : a + (1 << 16)]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([names[keys[r, 0]] for r, _, _ in some], pa.string()),
            "phrase": pa.array([" ".join([firsts[keys[r, 1]], *(words[w] for w in keys[r, 2:d].tolist())]) for r, d, _ in some], pa.string()),
            "words": pa.array([d - 1 for _, d, _ in some], pa.int32()), "n": pa.array([n for _, _, n in some], pa.int64())})


def _sort(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, whole = [], 0, True
        for block in (b for batch in batches for b in batch.column("block")):
            kept.extend(pa.ipc.open_stream(block.as_buffer()))
            held += len(kept[-1].column("ns").values)
            if held >= CHUNK:  # what a task sorts in several chunks are shares
                yield from sorted_lists(pa.Table.from_batches(kept), 0)
                kept, held, whole = [], 0, False
        if kept:
            yield from sorted_lists(pa.Table.from_batches(kept), least if whole else 0)

    return task


def phrase_counts(docs: DataFrame, min_count: int, hot_share: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, phrase, words, n): words per language, and every phrase of up to MAX_LEN words
    that occurs ``min_count`` times, single words too."""
    spark = docs.sparkSession
    texts = docs.select("lang", "text")
    singles = stages.write(texts.mapInArrow(_count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "singles")
    frequent = singles.where(F.col("n") >= min_count)
    total = singles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = singles.where(F.col("n") * hot_share > total).select("lang", "phrase").collect()  # fewer than hot_share rows
    hot_names = name_hashes(pa.array([r["lang"] for r in hot], pa.string()), pa.array([r["phrase"] for r in hot], pa.string()))
    state = spark.sparkContext.broadcast((bit_table(frequent), hot_names))
    parts = max(shuffle_width(spark), -(-total // TASK_PLACES))
    blocks = texts.mapInArrow(_cut(state, parts), "part int, block binary")
    shares = blocks.repartitionById(parts, "part").mapInArrow(_sort(min_count), "lang string, phrase string, words int, n long")
    longer = shares.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("n")).where(F.col("n") >= min_count)
    counts = stages.write(frequent.select("lang", "phrase", F.lit(1).alias("words"), "n").unionByName(longer), "counts")
    return singles.groupBy("lang").agg(F.sum("n").alias("n")), counts


# --- scores --------------------------------------------------------------------------


def with_count(rows: DataFrame, part: str, name: str, counts: DataFrame) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``. A part that many rows share meets
    one of SALTS copies of its count."""
    copies = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["lang", part, "salt"]).drop("salt")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, hot_share: int = HOT_SHARE) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    stages = Stages(docs.sparkSession, "phrases")
    totals, counts = phrase_counts(docs, min_count, hot_share, stages)
    phrases = counts.where("words > 1")
    inner = lambda start, phrase: F.array_join(F.slice(F.split("phrase", " "), start, F.col("words") - 1), " ").alias(phrase)
    longer = phrases.where("words > 2")
    around = longer.select("lang", inner(1, "phrase"), "n").unionByName(longer.select("lang", inner(2, "phrase"), "n")).groupBy("lang", "phrase").agg(F.max("n").alias("m"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where("m IS NULL OR m < n").drop("m")
    tokens = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({
        "left": F.array_join(F.slice(tokens, 1, F.col("k")), " "), "right": F.array_join(F.slice(tokens, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    cuts = reduce(lambda rows, part: with_count(rows, *part, counts), (("left", "l"), ("right", "r")), cuts).drop("left", "right")
    scored = cuts.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang")
    exact = scored.withColumn("score", F.expr("CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    best = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
