"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark
decontamination, packing. Each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last keep the columns of documents.
Empty tables and null texts are passed through as the operators define. Further columns, whatever
their names, travel under names that no operator uses and come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.decontam import decontaminate
from webloom.llm.line_dedup import without_duplicate_lines
from webloom.llm.minhash import near_duplicates
from webloom.llm.packing import pack_documents
from webloom.llm.quality import cleaned
from webloom.llm.stages import Stages

#: No stage can be checked by SQL: tokenizer, template classes.
ORACLE_SQL = None


#: The columns that operators read.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with all further columns of the documents under other names while it runs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"further_column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*names.values()), sf_dir)
        return out.select(*names.values()).toDF(*names)

    return run_stage


@apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of a host hold."""
    return cleaned(docs)


@apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line where it occurs first; documents of which no line is left go."""
    rows = without_duplicate_lines(docs).where(~F.col("emptied")).drop("emptied")
    return rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else rows


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    groups = near_duplicates(docs).select("doc_id", "kept").distinct()
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


@apart
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir), name)
    return docs
