"""Near-identical lines across documents by a segment-partition edit join.

Lines of at least ``MIN_CHARS`` characters within ``DISTANCE`` edits of each other are
copies. A line falls into DISTANCE + 1 segments; of two lines within that distance, the
shorter one has a segment that the longer one holds at almost the same place. So every
line is indexed by its segments under (length, number, segment) and probes, for each
length up to DISTANCE shorter than its own, the few substrings that can meet a segment
there. Candidates are verified by the banded edit distance with that threshold.

Exact copies meet first, by hash, in one aggregate; distinct lines only are joined. A
bucket in which many lines share a segment is never paired off. Its lines first meet its
earliest line, as many rows as the bucket has; those within the distance are decided, and
pairs of two decided lines are not looked at again. Then the bucket is split by letters:
letters fall into 2 * DISTANCE + 1 groups, an edit touches two letters at most, so two close
lines hold the letters of at least one group in the same order. A line goes to one bucket
for each group, named by these letters, and a pair counts in the first group it has in common;
a bucket that is still wide is split by another
grouping of the letters, up to ``TURNS`` times, and what is left is joined whole. Rows of a
bucket meet under a condition on sketches of their words, after a split of their pairs of
letters, which two close lines always satisfy. DataFrame operations only.

A line stays where it occurs first (by doc_id, then line number) and goes everywhere else;
it goes everywhere if a line within the distance occurs before it.

Defined cases: a null text has no lines; blank lines are never copies and stay; lines are
compared without white space at their ends; shorter lines are compared exactly; rows equal
in doc_id and text are one document and get equal results; doc_ids may repeat with other
texts (ties go by a hash of the row); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.stages import Stages
from webloom.session import broadcast_if_small

DISTANCE = 2
MIN_CHARS = 20
#: Pairs a bucket may give before it is split.
WIDE = 1024
#: Times a bucket is split by the letters of its lines.
TURNS = 2

BLANKS = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, pos, line, id, len) of every line that is not blank."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.expr(f"trim(BOTH {BLANKS} FROM line)")).where("line <> ''")
    return rows.withColumns({"id": F.xxhash64("line"), "len": F.length("line")})


def shifts(distance: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring a line has to probe besides its
    own segments: shifts that keep the edits before and after the segment within bounds."""
    out = []
    for d in range(distance + 1):
        for i in range(distance + 1):
            low, high = max(-i, d - (distance - i)), min(i, d + (distance - i))
            out += [(d, i, s) for s in range(low, high + 1) if (d, s) != (0, 0)]
    return out


def slots(distance: int) -> list[tuple[int, int, int]]:
    """(d, i, shift) of every key of a line: its own segments first, then its probes."""
    return [(0, i, 0) for i in range(distance + 1)] + shifts(distance)


def slot_place(slot: tuple[int, int, int], length: str, parts: int) -> tuple[str, str, str]:
    """SQL for the length of the shorter line, and the start and end of a slot's substring."""
    d, i, shift = slot
    short = f"({length} - {d})"
    return short, f"cast({short} * {i} div {parts} + {shift} as int)", f"cast({short} * {i + 1} div {parts} + {shift} as int)"


def segment_keys(distance: int) -> Column:
    """Array with a key per slot, null where the line has no such substring."""
    out = []
    for slot in slots(distance):
        short, start, end = slot_place(slot, "len", distance + 1)
        key = f"xxhash64(0L, {short}, {slot[1]}, substring(line, {start} + 1, {end} - {start}))"
        out.append(f"case when {short} >= 0 and {start} >= 0 and {end} <= len then {key} end")
    return F.expr(f"array({', '.join(out)})")


def letter_keys(distance: int, turn: int) -> Column:
    """Array with a hash per group of letters: the line's letters of that group in order."""
    n = 2 * distance + 1
    mine = f"filter(split(line, ''), c -> pmod(xxhash64(c, {turn}), {n}) = g)"
    return F.expr(f"transform(sequence(0, {n - 1}), g -> xxhash64({turn}, g, array_join({mine}, '')))")


def sketch() -> Column:
    """64 bits of parities of the line's words: an edit changes three of them at most."""
    return F.expr("aggregate(split(line, ' '), 0L, (a, w) -> a ^ shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)))")


def fine_sketch() -> Column:
    """64 bits of parities of the line's pairs of letters: an edit changes four of them at most."""
    pairs = "sequence(1, len - 1), 0L, (a, i) -> a ^ shiftleft(1L, cast(pmod(xxhash64(substring(line, i, 2)), 64) as int))"
    return F.expr(f"case when len < 2 then 0L else aggregate({pairs}) end")


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    out = rows.select(*keep, F.posexplode("keys").alias("slot", "key"))
    return out.where("key is not null")


def sizes(rows: DataFrame) -> DataFrame:
    """Buckets that can give a pair: key, and the pairs that they give at most."""
    count = {"lines": F.count("*"), "owners": F.count_if("own"), "done": F.count_if(~F.col("open")), "done_owners": F.count_if(F.col("own") & ~F.col("open"))}
    found = rows.groupBy("key").agg(*(c.alias(n) for n, c in count.items()))
    found = found.where("owners > 0 and lines > 1").select("key", F.expr("owners * lines - done_owners * done").alias("cost"))
    return found.where("cost > 0")


def bucket_pairs(rows: DataFrame, bits: int) -> DataFrame:
    """Pairs of an owner of a bucket's segment and another line, not both decided, whose
    sketches differ in at most ``bits`` bits, in the bucket of their first common letters."""
    own = rows.where("own").select("key", F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("open").alias("oa"), F.col("before").alias("la"))
    every = rows.select("key", F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("open").alias("ob"), F.col("before").alias("lb"))
    near = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= bits
    both = own.join(every, "key").where((F.col("a") != F.col("b")) & near & (F.col("oa") | F.col("ob")) & ~F.arrays_overlap("la", "lb"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def close_to_first(wide: DataFrame, texts: DataFrame, distance: int) -> DataFrame:
    """(a, b): the earliest line of each bucket and the lines of the bucket close to it."""
    at = wide.select("key", "id").join(texts.select("id", "first"), "id")
    earliest = at.groupBy("key").agg(F.min(F.struct("first", "id"))["id"].alias("a"))
    met = wide.select("key", F.col("id").alias("b")).join(earliest, "key").where("a <> b").select("a", "b").distinct()
    lines = texts.select("id", "line")
    met = met.join(lines.toDF("a", "la"), "a").join(lines.toDF("b", "lb"), "b")
    return met.where(F.levenshtein("la", "lb", distance) >= 0).select("a", "b")


def close_lines(lines: DataFrame, first: DataFrame, stages: Stages, distance: int, min_chars: int) -> DataFrame:
    """(a, b): ids of different lines within ``distance`` edits; every line that has an
    earlier one so close is in a pair with an earlier one."""
    long_lines = lines.where(F.col("len") >= min_chars).select("id", "line", "len")
    keyed = long_lines.select("id", segment_keys(distance).alias("keys")).dropDuplicates(["id"])
    state = {"own": F.col("slot") <= distance, "open": F.lit(True), "before": F.array().cast("array<long>")}
    rows = exploded(keyed, "id").withColumns(state).drop("slot")
    met = stages.write(rows.join(sizes(rows), "key"), "met")
    # only lines that share a bucket are read once more: everything below works on them
    sharing = broadcast_if_small(met.select("id").distinct())
    shared = stages.write(long_lines.join(sharing, "id", "left_semi").dropDuplicates(["id"]), "shared-lines")
    rows = stages.write(met.join(shared.select("id", sketch().alias("sketch")), "id"), "buckets")
    stages.drop(met)
    pairs, close, wide_lines = None, None, None
    for turn in range(TURNS + 1):
        last = turn == TURNS
        few = bucket_pairs(rows if last else rows.where(F.col("cost") <= WIDE), 4 * distance if turn else 3 * distance)
        pairs = few if pairs is None else pairs.unionAll(few)
        wide = rows.where(F.col("cost") > WIDE)
        if last or wide.isEmpty():
            break
        if wide_lines is None:
            ids = broadcast_if_small(wide.select("id").distinct())
            found = shared.join(ids, "id", "left_semi")
            wide_lines = stages.write(found.withColumn("fine", fine_sketch()).join(first.select("id", "first"), "id"), "wide-lines")
            close = stages.write(close_to_first(wide, wide_lines, distance), "close-to-first")
            decided = close.select(F.col("b").alias("id")).distinct().withColumn("done", F.lit(True))
            wide = wide.join(decided, "id", "left").withColumn("open", F.col("done").isNull())
        letters = wide_lines.select("id", "fine", letter_keys(distance, turn).alias("letters"))
        finer = wide.select("key", "id", "own", "open", "before").join(letters.withColumnRenamed("fine", "sketch"), "id")
        finer = finer.select("key", "id", "sketch", "own", "open", "before", "letters", F.posexplode("letters").alias("g", "letter"))
        before = F.concat("before", F.slice("letters", 1, F.col("g")))
        finer = finer.select(F.xxhash64("key", "letter").alias("key"), "id", "sketch", "own", "open", before.alias("before"))
        finer = stages.write(finer, "split")
        rows = stages.write(finer.join(sizes(finer), "key"), "finer")
        stages.drop(finer)
    pairs = stages.write(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    texts = stages.write(shared.select("id", "line").join(broadcast_if_small(ids), "id", "left_semi"), "texts")
    both = pairs.join(texts.toDF("a", "la"), "a").join(texts.toDF("b", "lb"), "b")
    verified = both.where(F.levenshtein("la", "lb", distance) >= 0).select("a", "b")
    return stages.write(verified if close is None else verified.unionAll(close), "close")


def duplicate_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> tuple[DataFrame, Stages]:
    """(key, pos, near) of every line that goes; ``near`` where a different line takes its place."""
    stages = Stages(docs.sparkSession, "lines")
    lines = line_rows(docs)
    places = lines.select("id", "doc_id", "key", "pos")
    first = stages.write(places.groupBy("id").agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count("*").alias("n")), "first")
    close = close_lines(lines, first, stages, distance, min_chars)
    where = first.select("id", "first")
    ordered = close.join(where.toDF("a", "fa"), "a").join(where.toDF("b", "fb"), "b")
    later = ordered.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    later = stages.write(later, "later").withColumn("near", F.lit(True))
    marked = first.join(later, "id", "left").where("n > 1 or near")
    gone = places.join(marked.select("id", "first", F.coalesce("near", F.lit(False)).alias("near")), "id")
    gone = gone.where(F.col("near") | (F.struct("doc_id", "key", "pos") != F.col("first")))
    return gone.select("key", "pos", "near"), stages


def line_dedup(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_exact and n_near (lines that go), and
    ``removed``, their numbers from 0 joined by commas."""
    gone, _ = duplicate_lines(docs, distance, min_chars)
    per_doc = gone.distinct().groupBy("key").agg(
        F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_list("pos")).alias("gone"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n"), F.col("text").isNull().alias("none"))
    rows = rows.select("doc_id", "key", F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_lines"))
    zero = F.lit(0).cast("long")
    return rows.join(per_doc, "key", "left").select(
        "doc_id", "n_lines", F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"),
        F.concat_ws(",", F.transform(F.coalesce("gone", F.array().cast("array<int>")), lambda x: x.cast("string"))).alias("removed"))


def without_duplicate_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all its columns; texts without the lines that go. ``emptied`` marks
    documents that had text of which no visible line is left."""
    gone, stages = duplicate_lines(docs, distance, min_chars)
    lists = stages.write(gone.distinct().groupBy("key").agg(F.collect_list("pos").alias("gone_lines")), "gone").withColumnRenamed("key", "line_key")
    rows = docs.withColumn("line_key", F.xxhash64("doc_id", "text")).join(lists, "line_key", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone_lines", i)), "\n")
    text = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(kept)
    rows = rows.withColumn("text", text)
    emptied = F.col("gone_lines").isNotNull() & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return rows.withColumn("emptied", emptied).drop("line_key", "gone_lines")
