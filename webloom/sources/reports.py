"""Stored reports: reading one or many, writing reports, diffs, edges, the index."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import findings as G
from webloom.session import cut_lineage

FINDING = (
    "struct<id:string,severity:string,category:string,title:string,detail:string,url:string,element:string,"
    "evidence:map<string,string>,screenshot:string,how_to_fix:string,occurrences:bigint,other_urls:array<string>>"
)
REPORT = (
    "meta struct<target:string,generated_at:string,pages_tested:bigint,links_checked:bigint>, "
    f"summary struct<severity:map<string,bigint>,category:map<string,bigint>,total:bigint>, findings array<{FINDING}>, _corrupt string"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports (files, folders or a glob), one row each, with the file's name."""
    return (
        spark.read.schema(REPORT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumn("path", F.input_file_name())
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of one report, numbered in their order. A file without findings is an error."""
    report = read_reports(spark, path)
    bad = report.where("findings IS NULL").select("path").first()
    if bad is not None:
        raise ValueError(f"{bad.path} does not look like a report")
    rows = report.select(F.posexplode("findings").alias("pos", "f"))
    return rows.select(F.col("pos").cast("bigint").alias("seq"), "f.*")


def same_target(spark: SparkSession, before: str, after: str) -> bool:
    """Did the two runs test the same site? (Unknown targets count as the same.)"""
    targets = {r.t for p in (before, after) for r in read_reports(spark, p).select(F.col("meta.target").alias("t")).collect()}
    return len(targets - {None, ""}) <= 1


def run_history(spark: SparkSession, root: str, limit: int = 15) -> DataFrame:
    """The newest runs under ``root`` (folders named YYYYmmdd-HHMM…/report.json);
    unreadable reports are left out."""
    runs = read_reports(spark, root).where(F.col("path").endswith("/report.json") & F.col("summary").isNotNull() & F.col("meta.target").isNotNull())
    name = F.element_at(F.split("path", "/"), -2)
    when = F.concat(
        F.substring(name, 1, 4), F.lit("-"), F.substring(name, 5, 2), F.lit("-"), F.substring(name, 7, 2), F.lit(" "),
        F.substring(name, 10, 2), F.lit(":"), F.substring(name, 12, 2),
    )
    count = lambda s: F.coalesce(F.try_element_at("summary.severity", F.lit(s)), F.lit(0))
    return (
        runs.select(
            name.alias("run"), when.alias("when"), F.left("meta.target", F.lit(52)).alias("target"), F.col("meta.pages_tested").alias("pages"),
            F.col("summary.total").alias("total"), count("critical").alias("critical"), count("high").alias("high"),
        )
        .orderBy(F.desc("run"))
        .limit(limit)
    )


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges as CSV with a header and as JSON lines, in as many parts as there are."""
    rows = edges.select("source", "target", "anchor", "internal", "nofollow")
    rows.write.mode("overwrite").option("header", True).csv(os.path.join(path, "edges-csv"))
    rows.write.mode("overwrite").json(os.path.join(path, "edges-json"))


def write_report(findings: DataFrame, path: str) -> None:
    """Merged findings (with their ids) and their summary as JSON lines."""
    merged = cut_lineage(G.merge_findings(findings).withColumn("id", G.finding_id()), "report")
    merged.write.mode("overwrite").json(os.path.join(path, "findings"))
    G.summary(merged).write.mode("overwrite").json(os.path.join(path, "summary"))


def write_diff(changes: DataFrame, counts: DataFrame, path: str) -> None:
    """All changes but the unchanged ones, and the counts."""
    changes.where("change <> 'unchanged'").write.mode("overwrite").partitionBy("change").json(os.path.join(path, "changes"))
    counts.write.mode("overwrite").json(os.path.join(path, "counts"))


def write_index(board: DataFrame, lists: dict[str, DataFrame], path: str) -> None:
    """Leaderboard and the per-domain lists as JSON lines."""
    board.write.mode("overwrite").json(os.path.join(path, "leaderboard"))
    for name, rows in lists.items():
        rows.write.mode("overwrite").json(os.path.join(path, name))
