"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = plain_sql(oracle)
        return fn

    return keep


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
_MARK = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def plain_sql(sql: str) -> str:
    """``{table}`` marks become bare table names."""
    return _MARK.sub(r"\1", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows shaped from the given tables; ``{table}`` marks name them. The same
    text, unmarked, shapes them in the check SQL."""
    return spark.sql(_MARK.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", sql))
