"""Exact duplicates by a heavy-hitter split.

Every text is reduced to its SHA-256 once; only (doc_id, digest) rows go on. Each task counts
the digests of its rows in a Misra-Gries summary of ``counters`` entries. With N rows in all, a
summary is short of a digest's count by at most its task's rows / (counters + 1), so every digest
that N * 2 / (counters + 1) rows share has a summed lower bound above N / (counters + 1), and at
most ``counters`` digests can have such a bound: they are the candidates, and their number is
bounded whatever the data are. A second pass counts the candidates exactly and finds their winners
(verified); the table of winners, ``counters`` rows at most, is broadcast, and the rows of
frequent digests are judged where they stand, without a shuffle. All other digests, each of them
in a small share of the rows, meet their winner by an ordinary aggregate and join.

The row with the largest doc_id of equal texts stays. Defined cases: a null text counts as empty;
a null doc_id is smaller than any other; of rows that repeat both doc_id and text one
stays; an empty table gives no rows; columns of other names are ignored by
``exact_duplicates`` and returned by ``without_exact_duplicates``; long texts are hashed whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.names import free_names
from webloom.llm.stages import Stages

#: Entries of a Misra-Gries summary, and the most rows that are ever broadcast.
COUNTERS = 4096


def shrink(counts: Counter, counters: int) -> Counter:
    """The summary with at most ``counters`` entries: all lose the count of the first one beyond."""
    if len(counts) <= counters:
        return counts
    over = sorted(counts.values(), reverse=True)[counters]
    return Counter({d: n - over for d, n in counts.items() if n > over})


def _summarise(counters: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column("digest").to_pylist())
            counts = shrink(counts, counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    return task


def frequent_digests(rows: DataFrame, counters: int) -> DataFrame:
    """Candidates: at most ``counters`` digests, with every one that more than
    2 / (counters + 1) of the rows have."""
    total = rows.count()
    sums = rows.select("digest").mapInArrow(_summarise(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("least"))
    return sums.where(F.col("least") * (counters + 1) > total).select("digest")


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays (``best``) and the number of rows."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "tie")).alias("best"), F.count("*").alias("group_size"))


def exact_duplicates(docs: DataFrame, text: Column | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the row that stays), group_size, kept and
    text_sha256. ``text`` is the normal form that is compared (default: the text as it is)."""
    stages = Stages(docs.sparkSession, "exact")
    normal = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    hashed = docs.select("doc_id", F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))
    # numbers tell repeated rows apart; the written table keeps them
    rows = stages.write(hashed.withColumn("tie", F.monotonically_increasing_id()), "digests")
    candidates = stages.write(frequent_digests(rows, counters), "candidates")
    verified = stages.write(winners(rows.join(F.broadcast(candidates), "digest", "left_semi")), "winners")
    here = rows.join(F.broadcast(verified), "digest")
    rest = rows.join(F.broadcast(verified), "digest", "left_anti")
    # one row of a kind needs no winner: only the others travel on the winners' side
    shared = winners(rest).where("group_size > 1")
    there = rest.join(shared, "digest", "left")
    out = here.unionByName(there.select(*here.columns))
    alone = F.col("best").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("tie") == F.col("best.tie"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, text: Column | None = None, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stages = Stages(docs.sparkSession, "exact-kept")
    judged = stages.write(exact_duplicates(docs, text, counters), "judged")
    digest, gone, again, turn = free_names(docs, "digest", "gone", "again", "turn")
    rows = docs.withColumn(digest, F.sha2(F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary"), 256))
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    losers = judged.where(~F.col("kept") & ~same_id).select(F.col("text_sha256").alias(digest), F.col("doc_id").alias(gone)).distinct()
    left = rows.join(losers, (rows[digest] == losers[digest]) & rows["doc_id"].eqNullSafe(losers[gone]), "left_anti")
    repeated = judged.where(~F.col("kept") & same_id).select(F.col("text_sha256").alias(digest)).distinct()
    marked = left.join(repeated.withColumn(again, F.lit(True)), digest, "left")
    # rows that repeat id and text: one of them; no other row is sorted or moved
    one = Window.partitionBy(digest).orderBy("doc_id")
    twice = marked.where(F.col(again)).withColumn(turn, F.row_number().over(one)).where(F.col(turn) == 1)
    return marked.where(F.col(again).isNull()).select(*docs.columns).unionByName(twice.select(*docs.columns))
