"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised inside a sentence) and units
turn into typed placeholders, all others into their lower-case letters without punctuation
at the ends. Windows of ``WIDTH`` tokens of items and documents are joined by hash. Matched
windows of one item in one document at one shift are then checked for slot consistency: an
item's value must stand for one value of the document and the other way round. Windows with
inconsistent slots do not count. A document is contaminated by an item when consistent
windows cover ``MIN_WORDS`` words of it, or ``MIN_SHARE`` percent of a shorter item.

A capitalised word at the start of a sentence may be a name or any word, so windows have a
hash for each choice, in items and documents alike. Windows that rest on such a choice are
checked together with the others, but never take a window away that is sound without them.
Windows with fewer than ``MIN_LITERALS`` plain words, and all of items under ``MIN_ITEM``
words, are joined by their words as they stand, so exact copies are always found.

The benchmark is the query set: its window hashes go to the tasks in blocks of at most
``BLOCK`` hashes, each block against all documents, so any number of items works. Only
matched windows leave the tasks; a passage that a third of all documents hold costs rows in
proportion, and lists are kept per document and item only.

Defined cases: a null or empty text is clean; items shorter than a window are one window of
their length; equal rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrow_text import mix, signed, slices, split_words, string_hashes, window_hashes, window_starts
from webloom.llm.stages import Stages
from webloom.session import broadcast_if_small

WIDTH = 8
MIN_WORDS = 13
MIN_SHARE = 60
MIN_ITEM = 5
MIN_LITERALS = 4
BLOCK = 1_000_000

NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
#: Units of measure and money.
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "inch inches foot feet yard yards mile miles ounce ounces pound pounds ton tons litre litres liter liters meter meters metre metres "
    "gram grams kilogram kilograms kilometer kilometers kilometre kilometres degree degrees dollar dollars cent cents euro euros usd eur "
    "percent mph kmh w kw v a hz byte bytes kb mb gb".split()
)
EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
WORD, NUM, UNIT, NAME = 0, 1, 2, 3
MARKS = {NUM: "<number>", UNIT: "<unit>", NAME: "<name>"}
#: Stands for the choice of a window that is joined by its words as they stand.
LITERAL = -1


#: Words of small letters, perhaps after one capital, need no pattern of Python's.
SIMPLE = r"^(?:\p{Ll}+|[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]\p{Ll}+)$"


def classify(dictionary: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(core words in small letters, kinds, ends): words without punctuation, their kinds by
    shape alone, and whether a sentence ends with the word."""
    cores = pc.utf8_rtrim(dictionary, characters=".,;:!?")
    simple = pc.match_substring_regex(cores, SIMPLE)
    lower = pc.utf8_lower(cores)
    kinds = np.where(pc.match_substring_regex(cores, "^\\p{Lu}").to_numpy(zero_copy_only=False), NAME, WORD).astype(np.int8)
    kinds[pc.is_in(lower, pa.array(sorted(UNITS), lower.type)).to_numpy(zero_copy_only=False)] = UNIT
    ends = pc.match_substring_regex(dictionary, "[.!?:]$").to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
    odd = []
    for i, w in zip(other.tolist(), dictionary.take(pa.array(other)).to_pylist(), strict=True):
        core = EDGE.sub("", w)
        ends[i] = w.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
        kinds[i] = WORD
        if NUMBER.fullmatch(core):
            kinds[i] = NUM
        elif core.lower() in UNITS:
            kinds[i] = UNIT
        elif core[:1].isupper() and core[1:].islower():
            kinds[i] = NAME
        odd.append(core.lower())
    return pc.replace_with_mask(lower, pc.invert(simple), pa.array(odd, lower.type)), kinds, ends


#: Bits of the map of words that occur in items. It has one size, whatever the benchmark.
MAP_BITS = 1 << 23


class Template:
    """Template tokens of a batch of texts."""

    def __init__(self, texts: pa.Array, word_map: np.ndarray | None = None):
        words = self.words = split_words(texts)
        self.cores, kinds, ends = classify(words.dictionary)
        first = np.zeros(len(words.codes), bool)
        if len(first):
            first[1:] = ends[words.codes[:-1]]
            first[words.offsets[:-1][words.counts > 0]] = True
        self.kinds = kinds[words.codes]
        self.shapes = self.kinds.copy()
        self.kinds[first & (self.kinds == NAME)] = WORD  # a sentence may start with any word
        self.open = self.shapes != self.kinds
        coded = self.cores.dictionary_encode()
        of_core = string_hashes(coded.dictionary)[coded.indices.to_numpy()] if len(self.cores) else np.zeros(0, np.uint64)
        marks = np.zeros(4, np.uint64)
        marks[1:] = string_hashes(pa.array([MARKS[k] for k in (NUM, UNIT, NAME)]))
        self.plain = of_core[words.codes]
        self.hashes = np.where(self.kinds == WORD, self.plain, marks[self.kinds])
        self.named = np.where(self.open, marks[NAME], self.hashes)
        bare = np.flatnonzero(pc.equal(self.cores, "").to_numpy(zero_copy_only=False))
        same = of_core.copy()
        same[bare] = string_hashes(words.dictionary.take(pa.array(bare)))
        self.literal = same[words.codes]
        # a window with a plain word that no item has can match none
        self.possible = None
        if word_map is not None:
            in_items = word_map[of_core & np.uint64(MAP_BITS - 1)]
            self.possible = (self.shapes != WORD) | in_items[words.codes]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, hashes, choices) of all windows, one row for each choice of the capitalised
        words that start a sentence: bit i of a choice reads word i as a name, LITERAL reads
        all words as they stand."""
        total = len(self.hashes)
        if total < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.flatnonzero(window_starts(self.words.offsets, width, total)[: total - width + 1])
        if self.possible is not None:
            good = np.concatenate(([0], np.cumsum(self.possible)))
            starts = starts[good[starts + width] - good[starts] == width]
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        count = lambda x: (lambda c: c[starts + width] - c[starts])(sums(x))
        least = min(MIN_LITERALS, width - 1)
        # the same words are poor wherever they stand, as this counts shapes only
        poor = starts if width < MIN_ITEM else starts[count(self.shapes == WORD) < least]
        out = [(poor, runs_at(self.literal, poor, width, width + 1000), LITERAL)]
        if width >= MIN_ITEM:
            plain = count(self.kinds == WORD)
            rich = starts[plain >= least]
            out.append((rich, runs_at(self.hashes, rich, width, width), 0))
            some = np.flatnonzero(count(self.open) > 0)
            bits = sum((self.open[starts[some] + i].astype(np.int64) << i for i in range(width)), np.zeros(len(some), np.int64))
            patterns = np.unique(bits)
            for choice in range(1, 1 << width if len(some) else 1):
                if not (patterns & choice == choice).any():
                    continue
                own = some[bits & choice == choice]
                rich = starts[own[plain[own] - choice.bit_count() >= least]]
                if len(rich):
                    out.append((rich, self.chosen(rich, width, choice), choice))
        return tuple(np.concatenate(x) for x in ([o[0] for o in out], [o[1] for o in out], [np.full(len(o[0]), o[2], np.int64) for o in out]))

    def chosen(self, starts: np.ndarray, width: int, choice: int) -> np.ndarray:
        """Hashes of the windows under a choice, as ``window_hashes`` makes them."""
        rows = np.stack([(self.named if choice >> i & 1 else self.hashes)[starts + i] for i in range(width)], 1)
        return window_hashes(rows.ravel(), width, seed=width)[::width]

    def slots(self, start: int, width: int, choice: int = 0) -> list[str]:
        if choice == LITERAL:
            return []
        return [self.cores[self.words.codes[start + i]].as_py() for i in range(width) if self.kinds[start + i] != WORD or choice >> i & 1]


def runs_at(values: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Entries ``starts`` of ``window_hashes``; a few are made by themselves."""
    if len(starts) * width > len(values):
        return window_hashes(values, width, seed=seed)[starts]
    return window_hashes(values[starts[:, None] + np.arange(width)].ravel(), width, seed=seed)[::width]


def window_rows(template: Template, starts: np.ndarray, hashes: np.ndarray, choices: np.ndarray, width: int, ids: pa.Array, name: str) -> pa.RecordBatch:
    owner = np.searchsorted(template.words.offsets, starts, side="right") - 1
    return pa.RecordBatch.from_pydict({
        name: ids.take(pa.array(owner)), "hash": pa.array(signed(np.ascontiguousarray(hashes))),
        "at": pa.array(starts - template.words.offsets[owner], pa.int64()), "width": pa.array(np.full(len(starts), width, np.int64)),
        "size": pa.array(template.words.counts[owner], pa.int64()),
        "slots": pa.array([template.slots(s, width, c) for s, c in zip(starts.tolist(), choices.tolist(), strict=True)], pa.list_(pa.string())),
        "loose": pa.array(choices > 0),
    })


ROWS = "hash long, at long, width long, size long, slots array<string>, loose boolean"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        template = Template(part.column("text"))
        counts = template.words.counts
        for width in sorted({WIDTH, *(int(c) for c in counts if 0 < c < WIDTH)}):
            starts, hashes, choices = template.windows(width)
            size = counts[np.searchsorted(template.words.offsets, starts, side="right") - 1]
            mine = size >= WIDTH if width == WIDTH else size == width
            yield window_rows(template, starts[mine], hashes[mine], choices[mine], width, part.column("item_id"), "item_id")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places (word of 64, bits) in the map of the words that occur in items."""
    for part in slices(batches):
        at = np.unique(Template(part.column("text")).plain & np.uint64(MAP_BITS - 1)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"word": pa.array(at >> 6), "bits": pa.array(np.int64(1) << (at & 63))})


def item_word_map(benchmark: DataFrame) -> np.ndarray:
    """MAP_BITS truth values: true at the hash of each word of an item (MAP_BITS / 64 rows at most are collected)."""
    rows = benchmark.select("text").mapInArrow(_item_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _search(known, widths: list[int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, packed = known.value
        word_map = np.unpackbits(packed, bitorder="little").view(bool)
        for part in slices(batches):
            template = Template(part.column("text"), word_map)
            for width in widths:
                starts, hashes, choices = template.windows(width)
                if not len(starts):
                    continue
                found = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                hit = wanted[found] == hashes
                yield window_rows(template, starts[hit], hashes[hit], choices[hit], width, part.column("key"), "key")

    return task


def matched_windows(docs: DataFrame, items: DataFrame, word_map: np.ndarray) -> DataFrame:
    """Windows of documents (key, hash, at, ...) whose hash an item window has."""
    spark = docs.sparkSession
    blocks = 1 + items.count() // BLOCK
    packed = np.packbits(word_map, bitorder="little")
    found = None
    for b in range(blocks):
        some = items.where(F.pmod("hash", F.lit(blocks)) == b).select("hash", "width").distinct().toPandas()
        if not len(some):
            continue
        known = spark.sparkContext.broadcast((np.sort(some["hash"].to_numpy().astype(np.int64).view(np.uint64)), packed))
        hits = docs.select("key", "text").mapInArrow(_search(known, sorted(set(some["width"].tolist()))), f"key long, {ROWS}")
        found = hits if found is None else found.unionAll(hits)
    return found if found is not None else spark.createDataFrame([], f"key long, {ROWS}")


def contaminations(docs: DataFrame, benchmark: DataFrame, stages: Stages) -> DataFrame:
    """(key, item_id, words): items that contaminate a document and the words covered."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = stages.write(benchmark.select("item_id", "text").mapInArrow(_items, f"item_id {kind}, {ROWS}"), "items")
    hits = stages.write(matched_windows(docs, items, item_word_map(benchmark)).select("key", "hash", "at", "slots", F.col("loose").alias("free")), "hits")
    side = items.select("item_id", "hash", F.col("at").alias("p"), "width", "size", F.col("slots").alias("own"), "loose")
    pairs = hits.join(broadcast_if_small(side), "hash")
    values = F.array_distinct(F.zip_with("own", "slots", lambda a, b: F.struct(a.alias("i"), b.alias("d"))))
    window = F.struct("p", "width", values.alias("values"), (F.col("loose") | F.col("free")).alias("loose"))
    groups = pairs.groupBy("key", "item_id", (F.col("at") - F.col("p")).alias("shift")).agg(F.collect_set(window).alias("windows"), F.first("size").alias("size"))
    # an item's value with two values in the document, or the other way round
    strict = F.filter("windows", lambda w: ~w["loose"])
    groups = groups.withColumns({"seen": F.array_distinct(F.flatten("windows.values")), "firm": F.array_distinct(F.flatten(F.transform(strict, lambda w: w["values"])))})
    clash = lambda c: F.filter(c, lambda x: F.exists(c, lambda y: ((x["i"] == y["i"]) & (x["d"] != y["d"])) | ((x["d"] == y["d"]) & (x["i"] != y["i"]))))
    groups = groups.withColumns({"clash": clash("seen"), "firm_clash": clash("firm")})
    sound = F.filter("windows", lambda w: ~F.arrays_overlap(w["values"], F.col("clash")) | (~w["loose"] & ~F.arrays_overlap(w["values"], F.col("firm_clash"))))
    covered = F.array_distinct(F.flatten(F.transform(sound, lambda w: F.sequence(w["p"], w["p"] + w["width"] - 1))))
    places = groups.select("key", "item_id", "size", F.explode(covered).alias("place")).distinct()
    total = places.groupBy("key", "item_id").agg(F.count("*").alias("words"), F.first("size").alias("size"))
    return total.where((F.col("words") >= MIN_WORDS) | (100 * F.col("words") >= MIN_SHARE * F.col("size"))).select("key", "item_id", "words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` with all its columns and ``contaminated``, ``bench_items`` (ids in
    order) and ``bench_words`` (most words of one item)."""
    stages = Stages(docs.sparkSession, "decontam")
    keyed = docs.withColumn("bench_key", F.xxhash64("text"))
    found = contaminations(keyed.select(F.col("bench_key").alias("key"), "text"), benchmark, stages)
    per_doc = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("bench_items"), F.max("words").alias("bench_words"))
    per_doc = stages.write(per_doc, "verdicts").withColumnRenamed("key", "bench_key")
    out = keyed.join(broadcast_if_small(per_doc), "bench_key", "left").drop("bench_key")
    return out.withColumns({"contaminated": F.col("bench_words").isNotNull(), "bench_words": F.coalesce("bench_words", F.lit(0)).cast("long")})
