"""Session helpers: lineage folder, size-checked broadcasts, written stages."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is proven to hold at most this many rows.
BROADCAST_ROWS = 200_000
#: Shuffle files go when the job that made them ends, not when the driver next collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def active_session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the session names none (tests, one machine) a folder is made and
    set for the rest of the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("webloom.local.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("webloom.local.checkpoint.dir", named)
    return named


_freeing: dict[str, list] = {}  # session -> [blocks inside, the caller's setting]
_lock = threading.Lock()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end. The caller's setting comes back with the last
    of the blocks that threads of one session are in."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        inside = _freeing.setdefault(key, [0, spark.conf.get(FREE_SHUFFLES, None)])
        inside[0] += 1
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            inside[0] -= 1
            if not inside[0]:
                before = _freeing.pop(key)[1]
                spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one pass, no lineage,
    the rows outlive any lost executor, and the shuffle files of the pass go with it."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    with freeing(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` is proven to hold at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting; a larger side keeps the shuffle join
    (adaptive execution splits its hot keys)."""
    return F.broadcast(df) if fits(df, rows) else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def build_session(app: str = "webloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; a cluster's own
    values (given through ``conf`` or spark-submit) win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # plans here are large; recording a call site per expression doubles their build time
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
