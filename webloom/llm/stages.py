"""Written intermediate tables in the shared folder, and their removal."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from webloom.session import shared_dir


class Stages:
    """Tables of one run under ``spark.checkpoint.dir``. ``write`` cuts the lineage, so
    rows outlive a lost executor; ``drop`` removes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
        self.paths: dict[int, str] = {}
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = os.path.join(self.root, f"{self.made:03d}-{name}")
        df.write.mode("errorifexists").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path is not None:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
