"""Iterative graph jobs: PageRank by power iteration, breadth-first reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.places import numbered
from webloom.operators.ranks import graph_ranks
from webloom.session import cut_lineage


def power_iteration(
    edges: DataFrame,
    nodes: DataFrame,
    damping: float = 0.85,
    iterations: int = 40,
    tol: float | None = None,
) -> DataFrame:
    """Weighted PageRank of one graph. ``edges``: src, dst, w (one row per pair, no self loops);
    ``nodes``: node. Returns node, rank; ranks sum to 1. The rounds are those of ``graph_ranks``."""
    one = F.lit("").alias("site")
    return graph_ranks(edges.select(one, "src", "dst", "w"), nodes.select(one, "node"), damping, iterations, tol).select("node", "rank")


def internal_pagerank(visited: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 40) -> DataFrame:
    """PageRank over the visited pages of a site, scaled so that the best is 100."""
    nodes = visited.select(F.col("url").alias("node")).distinct()
    follow = edges.where("internal AND NOT nofollow AND source <> target")
    pairs = follow.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1).alias("w")).distinct()
    ranks = power_iteration(pairs, nodes, damping, iterations)
    top = ranks.agg(F.max("rank")).first()[0] or 1.0
    return ranks.select(F.col("node").alias("url"), F.bround(F.col("rank") / F.lit(top) * 100, 1).alias("pagerank"))


def reach(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int,
    max_pages: int,
    gate=None,
    allow_subdomains: bool = False,
) -> DataFrame:
    """Pages a crawl of known links would visit, breadth first: url, base, depth, place.

    ``edges``: source, target, seq (order of the links of a page); ``seeds``: url
    (each its own site), seq. ``gate(url, base)`` gives a reason to leave a URL
    alone. Every site has its own budget of ``max_pages``. ``place`` is the number of
    the visit in its site, from 1. A seed is visited whatever the gate says. Each depth
    is written once and never again; a small filter spares new pages the join with the
    visited ones.
    """
    gate = gate or (lambda u, b: U.visit_gate(u, b, allow_subdomains))
    level = seeds.select("url", F.col("url").alias("base")).distinct()
    level = cut_lineage(level.select("url", "base", F.lit(1).cast("long").alias("place"), F.lit(0).alias("depth")), "visit")
    levels, marks = [level], _marks(level)
    for depth in range(1, max_depth + 1):
        # places run on from depth to depth, so the last one is the number of pages a site has used
        used = level.groupBy("base").agg(F.max("place").alias("used")).where(F.col("used") < max_pages)
        step = (
            level.join(used.select("base"), "base", "left_semi")
            .select(F.col("url").alias("source"), "base", "place")
            .join(edges.select("source", "target", "seq"), "source")
            .groupBy(F.col("target").alias("url"), "base")
            .agg(F.min(F.struct("place", "seq")).alias("o"))
        )
        step = step.where(gate(F.col("url"), F.col("base")).isNull())
        placed = numbered(_unvisited(step, levels, marks), ["base"], ["o", "url"], "level")
        number = F.col("place") + F.col("used")
        level = cut_lineage(
            placed.join(used, "base").where(number <= max_pages)
            .select("url", "base", number.alias("place"), F.lit(depth).alias("depth")),
            "visit",
        )
        if level.isEmpty():
            break
        levels.append(level)
        marks = cut_lineage(marks.unionAll(_marks(level)).groupBy("word").agg(F.bit_or("bits").alias("bits")), "marks")
    return _all(levels)


#: Words of 64 bits in the filter of visited pages: it has at most so many rows, however many pages there are.
FILTER_WORDS = 1 << 20


def _filter_place(rows: DataFrame) -> DataFrame:
    """``rows`` (url, base, …) with the word of the filter a page falls in and its two bits there."""
    bit = lambda shift: f"shiftleft(1L, CAST(shiftrightunsigned(h, {shift}) & 63 AS INT))"
    return (
        rows.withColumn("h", F.xxhash64("base", "url"))
        .withColumn("word", F.col("h").bitwiseAND(F.lit(FILTER_WORDS - 1)))
        .withColumn("bits", F.expr(f"{bit(40)} | {bit(52)}"))
        .drop("h")
    )


def _marks(level: DataFrame) -> DataFrame:
    """Filter rows (word, bits) of the pages of a level."""
    return _filter_place(level.select("url", "base")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, levels)


def _unvisited(step: DataFrame, levels: list[DataFrame], marks: DataFrame) -> DataFrame:
    """Pages of ``step`` that no level has. The filter clears most new pages inside their
    row; only those it cannot clear meet the visited pages, exactly. A full filter clears
    nothing, and all meet them."""
    held = F.broadcast(marks.select("word", F.col("bits").alias("held")))
    hit = F.col("bits").bitwiseAND(F.coalesce("held", F.lit(0))) == F.col("bits")
    probed = cut_lineage(_filter_place(step).join(held, "word", "left").withColumn("doubtful", hit).drop("word", "bits", "held"), "step")
    doubtful = probed.where("doubtful").join(_all([v.select("url", "base") for v in levels]), ["url", "base"], "left_anti")
    return probed.where("NOT doubtful").unionByName(doubtful).drop("doubtful")
