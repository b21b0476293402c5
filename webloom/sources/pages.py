"""Scans: captured pages, seed lists, topic terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import topic_norm


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: page_id, url, html and whatever else the capture holds
    (status, headers, rendered text). Parquet, so unused columns are never read."""
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Page parsing is bound by CPU: a scan that comes in fewer pieces than there
    are cores is spread over them. Larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed list: blank lines and # lines off, https:// where no scheme is given."""
    line = F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    has_scheme = line.startswith("http://") | line.startswith("https://")
    return (
        spark.read.text(path)
        .where((line != "") & ~line.startswith("#"))
        .select(F.when(has_scheme, line).otherwise(F.concat(F.lit("https://"), line)).alias("seed"))
    )


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Topic terms in normal form; blank lines and lines that begin with # are dropped."""
    term = F.trim(topic_norm(F.col("value")))
    return (
        spark.read.text(path)
        .where((F.trim("value") != "") & ~F.col("value").startswith("#"))
        .select(term.alias("term"))
        .where("term <> ''")
    )
