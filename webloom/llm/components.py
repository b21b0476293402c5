"""Connected components by randomised contraction, in DataFrame operations only.

Every round, each node joins the neighbour (or itself) with the smallest hash; edges
are renamed to the chosen nodes, loops and repeats go. The number of nodes falls by a
constant factor per round whatever the shape of the graph, so long chains take few
rounds too. The choice is a minimum with partial aggregation, so a node with a third
of all edges sends one row per task; renaming is a join that adaptive execution may
split. Nothing is collected but the number of edges left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.stages import Stages


def connected_components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; direction, loops, repeats
    and nulls do not matter). Nodes of one component, and only they, share a root."""
    live = stages.write(
        edges.select("a", "b").where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    turn = 0
    while not live.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("best"))
        pick = stages.write(pick.select("node", F.least(F.col("best"), rank("node"))["v"].alias("to")), "pick")
        left, right = pick.toDF("a", "ta"), pick.toDF("b", "tb")
        after = live.join(left, "a").join(right, "b").where("ta <> tb")
        after = after.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        after = stages.write(after, "edges")
        if roots is None:
            now = pick.select("node", F.col("to").alias("root"))
            keep = pick
        else:
            moved = roots.join(pick.toDF("root", "to"), "root", "left")
            now = keep = stages.write(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
            stages.drop(roots)
            stages.drop(pick)
        stages.drop(live)
        live = after
        if keep is pick:
            stages.paths[id(now)] = stages.paths.pop(id(pick))
        roots = now
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return roots
