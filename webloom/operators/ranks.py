"""PageRank over any number of graphs at once."""

from __future__ import annotations

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import broadcast_if_small, fits, freeing, shared_dir
from webloom.sources.shared_files import SharedFiles

#: edges of one source that one task takes; a source with more is split
SLICE_EDGES = 1_000_000
#: edges per task of a round
TASK_EDGES = 250_000
#: rounds that one written table takes, and the edges and nodes above which it is one round: the shuffle files
#: of all rounds of a job lie on disk at once
ROUNDS = 8
JOB_ROWS = 1_000_000


class Workspace:
    """Tables of one job in the shared folder; each can be removed when nothing reads it any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.files = spark, SharedFiles(spark)
        self.root = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
        self.made = 0

    def write(self, df: DataFrame, name: str) -> str:
        self.made += 1
        path = os.path.join(self.root, f"{self.made:04d}-{name}")
        with freeing(df.sparkSession):
            df.write.mode("errorifexists").parquet(path)
        return path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.write(df, name)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, path: str) -> None:
        self.files.remove(path)

    def keep(self, *endings: str) -> None:
        """Removes all tables but those with these names."""
        for name in self.files.names(self.root):
            if not name.endswith(endings):
                self.remove(os.path.join(self.root, name))


def _slices(degree: Column) -> Column:
    return F.ceil(degree / F.lit(SLICE_EDGES)).cast("int")


def _system(edges: DataFrame, ids: DataFrame, damping: float, rounds: int | None, space: Workspace) -> tuple[DataFrame, DataFrame, int, bool]:
    """The iteration as shares and nodes: rank'(t) = c(t) + sum over s of rank(s) * share(s, t); the rounds of
    a job; and whether masses are few.

    Pages without links give their rank to all pages of their graph. That mass has a row of its own per
    graph (a negative id): what a page sends to pages without links, the mass gains in the same round, so
    it is always the sum of their ranks, and it gives each page of its graph an equal share. Node counts
    and mass are rows, so one iteration serves any number of graphs. Few masses are broadcast in jobs of one
    round; others have a share for each page, and a mass, like a page with very many links, is cut into slices.
    """
    sites = ids.groupBy("site").agg(F.count("*").alias("n"), (-1 - F.min("id")).alias("mass"))
    small = fits(sites)
    of_graphs = lambda rows: F.broadcast(rows) if small else rows  # noqa: E731  one row per graph at most
    end = lambda side, out: ids.select("site", F.col("node").alias(side), F.col("id").alias(out))
    # one end a job, so that the shuffles of one end are gone before those of the other
    pairs = space.table(edges.where("w > 0").join(end("src", "s"), ["site", "src"]).select("site", "dst", "s", "w"), "sources")
    pairs = space.table(pairs.join(end("dst", "t"), ["site", "dst"]).select("s", "t", "w"), "pairs")
    rounds = rounds or (ROUNDS if pairs.count() + ids.count() <= JOB_ROWS else 1)
    few = small and rounds == 1
    out = pairs.groupBy("s").agg(F.sum("w").alias("total"), F.count("*").alias("degree"))
    nodes = ids.select("site", F.col("id").alias("s")).join(out, "s", "left").join(of_graphs(sites), "site")
    nodes = space.table(nodes.select("s", "n", "mass", "total", "degree", F.col("total").isNull().alias("ends")), "nodes")
    links = pairs.join(nodes.select("s", "total"), "s").select("s", "t", (F.lit(damping) * F.col("w") / F.col("total")).alias("share"))
    ends = nodes.where("ends").select(F.col("s").alias("t"), "mass")
    lost = links.join(ends, "t").groupBy("s", F.col("mass").alias("t")).agg(F.sum("share").alias("share"))
    # graphs without such pages have no mass
    masses = nodes.groupBy("mass").agg(F.count_if("ends").alias("k"), F.max("n").alias("n")).where("k > 0")
    kept = masses.select(F.col("mass").alias("s"), F.col("mass").alias("t"), (damping * F.col("k") / F.col("n")).alias("share"))
    shares = links.unionByName(lost).unionByName(kept)
    if not few:
        given = nodes.join(of_graphs(masses.select("mass")), "mass", "left_semi").select(F.col("mass").alias("s"), F.col("s").alias("t"), (damping / F.col("n")).alias("share"))
        shares = shares.unionByName(given)
    rest = (1.0 - damping) / F.col("n")
    start = nodes.select(F.col("s").alias("id"), "mass", (damping / F.col("n")).alias("give"), _slices(F.coalesce("degree", F.lit(0)) + 2).alias("slices"), rest.alias("c"), (1.0 / F.col("n")).alias("rank"))
    none = [F.lit(None).cast("long").alias("mass"), F.lit(None).cast("double").alias("give")]
    sent = F.lit(1) if few else F.col("n") + 1
    start = start.unionByName(masses.select(F.col("mass").alias("id"), *none, _slices(sent).alias("slices"), (rest * F.col("k")).alias("c"), (F.col("k") / F.col("n")).alias("rank")))
    return shares, start, rounds, few


def graph_ranks(
    edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 40, tol: float | None = None, rounds: int | None = None
) -> DataFrame:
    """Weighted PageRank of many graphs. ``edges``: site, src, dst, w (one row per pair, no self
    loops); ``nodes``: site, node. Returns site, node, rank; the ranks of a graph sum to 1.

    The shares are cached, spread on the source (and slice, if a source has several) and sorted by it, the
    nodes with their constants on the node. ``rounds`` rounds are one job: each is a join with the cached shares, an
    aggregate of numbers only (no lists, which Spark would have to sort for) and a join with the nodes, which lie where the
    sums do. With ``tol`` a page's row also carries its rank after each round of the job, and the ranks are those after
    the first round whose change, over all graphs, is below it. Tables are removed, and shuffle files with the job that
    made them, when nothing reads them any more. The rounds run in a
    session of their own, whose shuffles have the shape of the shares; the caller's settings stay.
    """
    caller = edges.sparkSession
    space = Workspace(caller, "ranks")
    ids = space.table(nodes.select("site", "node").distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
    shares, start, rounds, few = _system(edges, ids, damping, rounds, space)
    path = space.write(start, "start")
    start = caller.read.schema(start.schema).parquet(path)
    hot = start.agg(F.max("slices")).first()[0] or 1
    spark = caller.newSession()
    several = F.broadcast(spark.read.schema(start.schema).parquet(path).where("slices > 1").select("id", "slices"))  # one row per million edges at most
    before = space.write(start.select("id", F.col("rank").alias("r0")), "round-0")
    if tol is not None:
        # a row that carries a node to itself keeps its ranks
        shares = shares.unionByName(start.select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(None).cast("double").alias("share")))
    keys = ["s"]
    if hot > 1:
        keys = ["s", "slice"]
        wide = F.broadcast(start.where("slices > 1").select(F.col("id").alias("s"), "slices"))
        place = F.when(F.col("share").isNull() | F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("t"), F.col("slices")))
        shares = shares.join(wide, "s", "left").select("s", "t", "share", place.cast("int").alias("slice"))
    shares = spark.read.parquet(space.write(shares, "shares"))
    space.keep("-ids", "-start", "-round-0", "-shares")
    constants = spark.read.schema(start.schema).parquet(path).select("id", "c", *(["mass", "give"] if few else []))
    width = int(1 + (shares.count() + constants.count()) // TASK_EDGES)
    for key, value in (("spark.sql.shuffle.partitions", width), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", -1)):
        spark.conf.set(key, value)
    shares = shares.repartition(width, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    constants = constants.repartition(width, "id").sortWithinPartitions("id").persist(StorageLevel.MEMORY_AND_DISK)
    state = spark.read.parquet(before)
    left, last = iterations, 0
    while left:
        done = min(rounds, left)
        left -= done
        after, held = state.select("id", F.col(f"r{last}").alias("r0")), ["r0"]
        for i in range(1, done + 1):
            sent = after.withColumnRenamed("id", "s")
            if hot > 1:
                turns = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
                sent = after.join(several, "id", "left").select(F.col("id").alias("s"), *held, F.explode(turns).alias("slice"))
            kept = [F.max(F.when(F.col("share").isNull(), F.col(r))).alias(r) for r in held] if tol is not None else []
            gained = F.sum(F.col(held[-1]) * F.col("share")).alias("gained")
            sums = sent.join(shares, keys).groupBy(F.col("t").alias("id")).agg(*kept, gained)
            rank = F.col("c") + F.coalesce("gained", F.lit(0.0))
            met = constants.join(sums, "id", "left")
            if few:
                masses = after.where("id < 0").select(F.col("id").alias("mass"), F.col(held[-1]).alias("lost"))
                met = met.join(F.broadcast(masses), "mass", "left")
                rank += F.coalesce(F.col("lost") * F.col("give"), F.lit(0.0))
            after = met.select("id", *(held if tol is not None else []), rank.alias(f"r{i}"))
            held = [*held, f"r{i}"] if tol is not None else [f"r{i}"]
        path = space.write(after, "round")
        state = spark.read.parquet(path)
        space.remove(before)
        before, last = path, done
        if tol is not None:
            step = lambda i: F.sum(F.when(F.col("id") >= 0, F.abs(F.col(f"r{i + 1}") - F.col(f"r{i}")))).alias(f"r{i}")
            changes = state.agg(*[step(i) for i in range(done)]).first()
            enough = next((i for i, change in enumerate(changes) if change is not None and change < tol), None)
            if enough is not None:
                last = enough + 1
                break
    shares.unpersist()
    constants.unpersist()
    final = caller.read.parquet(before).where("id >= 0").select("id", F.col(f"r{last}").alias("rank"))
    out = space.table(final.join(ids, "id").select("site", "node", "rank"), "ranks")
    space.keep("-ranks")
    return out


def site_pagerank(visited: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 40) -> DataFrame:
    """PageRank over the visited pages of every site: site, url, pagerank, scaled per site so that its best page has 100.

    ``visited``: site, url; ``edges``: site, source, target, internal, nofollow.
    """
    nodes = visited.select("site", F.col("url").alias("node")).distinct()
    follow = edges.where("internal AND NOT nofollow AND source <> target").select("site", F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    ranks = graph_ranks(follow.withColumn("w", F.lit(1)), nodes, damping, iterations)
    top = ranks.groupBy("site").agg(F.max("rank").alias("top"))
    return ranks.join(broadcast_if_small(top), "site").select("site", F.col("node").alias("url"), F.bround(F.col("rank") / F.col("top") * 100, 1).alias("pagerank"))
