"""Domain authority: PageRank and referring breadth, blended to 1..100."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import urls as U
from webloom.operators import index as I
from webloom.operators.graph import power_iteration
from webloom.session import cut_lineage


def pagerank(domain_edges: DataFrame, damping: float = 0.85, iterations: int = 60, tol: float = 1e-9) -> DataFrame:
    """Weighted PageRank over domain pairs; every end of a pair is a node."""
    pairs = domain_edges.where("source_domain <> target_domain").select(
        F.col("source_domain").alias("src"), F.col("target_domain").alias("dst"), F.col("weight").alias("w")
    )
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ranks = power_iteration(pairs, nodes, damping, iterations, tol)
    return ranks.select(F.col("node").alias("domain"), F.col("rank").alias("pagerank"))


def lognorm(df: DataFrame, column: str, out: str) -> DataFrame:
    """log10, then min-max to 0..1; all 1 when the values hardly differ. The two
    bounds come from one small aggregate."""
    logged = F.when(F.col(column).isNotNull(), F.log10(F.greatest(F.col(column), F.lit(1e-12))))
    lo, hi = df.agg(F.min(logged), F.max(logged)).first()
    if lo is None or hi - lo < 1e-9:
        return df.withColumn(out, F.when(logged.isNotNull(), F.lit(1.0)))
    return df.withColumn(out, (logged - F.lit(lo)) / F.lit(hi - lo))


def authority(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """Every known domain with its score and what it is made of. The key sets are
    merged as rows of one aggregate instead of outer joins."""
    follow = cut_lineage(I.domain_edges(edges, follow_only=True), "domain-edges")
    ranks = pagerank(follow)
    refdoms = follow.groupBy(F.col("target_domain").alias("domain")).agg(F.count("*").alias("follow_refdoms"))
    signals = (
        ranks.unionByName(refdoms, allowMissingColumns=True)
        .unionByName(I.domain_counts(edges), allowMissingColumns=True)
        .unionByName(I.align_domains(domains).select("domain", "crawled", "offtopic"), allowMissingColumns=True)
    )
    known = signals.groupBy("domain").agg(
        F.max("pagerank").alias("pagerank"),
        (F.coalesce(F.max("follow_refdoms"), F.lit(0)) + 1).alias("breadth"),
        F.coalesce(F.max("referring_domains"), F.lit(0)).alias("referring_domains"),
        F.coalesce(F.max("backlinks"), F.lit(0)).alias("backlinks"),
        (F.coalesce(F.max("crawled"), F.lit(0)) == 1).alias("crawled"),
        (F.coalesce(F.max("offtopic"), F.lit(0)) == 1).alias("offtopic"),
    )
    known = cut_lineage(known, "signals")
    scored = lognorm(known.withColumn("positive", F.when(F.col("pagerank") > 0, F.col("pagerank"))), "positive", "by_rank")
    scored = lognorm(scored, "breadth", "by_breadth")
    blend = 0.55 * F.coalesce("by_rank", F.lit(0.0)) + 0.45 * F.col("by_breadth")
    scored = scored.withColumn("blend", blend)
    top = scored.agg(F.max("blend")).first()[0] or 1.0
    score = F.greatest(F.lit(1), F.bround(F.lit(100) * F.col("blend") / F.lit(top)).cast("int"))
    return scored.withColumn("authority", score)


def leaderboard(edges: DataFrame, domains: DataFrame) -> DataFrame:
    utility = U.is_utility("domain") | U.is_infrastructure("domain") | F.col("offtopic")
    return (
        authority(edges, domains)
        .select(
            "domain",
            "authority",
            F.round(F.coalesce("pagerank", F.lit(0.0)), 8).alias("pagerank"),
            "referring_domains",
            "backlinks",
            "crawled",
            utility.alias("utility"),
            (F.col("referring_domains") < seeds.MIN_REFDOMS_TO_RANK).alias("thin"),
        )
        .orderBy(F.desc("authority"), F.desc("referring_domains"), F.desc("backlinks"), "domain")
    )


def ranking(board: DataFrame, show_utility: bool = False, show_thin: bool = False, q: str = "", k: int | None = 10) -> DataFrame:
    """What a reader sees first: utility and thin domains hidden, name search, top k."""
    rows = board
    if not show_utility:
        rows = rows.where("NOT utility")
    if not show_thin:
        rows = rows.where("NOT thin")
    if q:
        rows = rows.where(F.lower("domain").contains(q.lower()))
    rows = rows.orderBy(F.desc("authority"), F.desc("referring_domains"), F.desc("backlinks"), "domain")
    return rows if k is None else rows.limit(k)


def hidden_counts(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count_if("utility").alias("hidden"), F.count_if(F.col("thin") & ~F.col("utility")).alias("thin")
    )


def link_intersect(referring: DataFrame, board: DataFrame, me: str, k: int = 40, shown: int = 4) -> DataFrame:
    """Domains that link to rivals but not to ``me``: domain, authority, rivals and
    the first few rivals in leaderboard order. ``referring`` holds all
    referrers of every domain (domain, other, authority)."""
    mine = referring.where(F.col("domain") == me).select("other")
    rivals = referring.where((F.col("domain") != me) & (F.col("other") != me) & (F.col("other") != F.col("domain")))
    rivals = rivals.join(mine, "other", "left_anti").select("domain", "other", "authority")
    best = (
        rivals.groupBy("other")
        .agg(F.count_distinct("domain").alias("rivals"), F.max("authority").alias("authority"))
        .orderBy(F.desc("rivals"), F.desc("authority"), "other")
        .limit(k)
    )
    order = board.select("domain", F.col("authority").alias("a"), "referring_domains", "backlinks")
    w = Window.partitionBy("other").orderBy(F.desc("a"), F.desc("referring_domains"), F.desc("backlinks"), "domain")
    names = (
        rivals.join(F.broadcast(best.select("other")), "other", "left_semi")  # at most k rows
        .join(order, "domain")
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= shown)
        .groupBy("other")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "domain"))), lambda x: x["domain"]).alias("first_rivals"))
    )
    return best.join(names, "other").select(F.col("other").alias("domain"), "authority", "rivals", "first_rivals")


def intersect_choices(board: DataFrame) -> DataFrame:
    """Domains one may take as one's own: the crawled ones, else all."""
    crawled = board.where("crawled")
    return (board if crawled.isEmpty() else crawled).select("domain")
