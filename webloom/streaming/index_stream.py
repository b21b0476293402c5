"""Edges that arrive as files are merged into the stored index batch by batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from webloom.sources.index_tables import IndexTables

EDGE_BATCH = "source string, target string, anchor string, internal boolean, nofollow boolean, seq bigint"


def index_stream(
    spark: SparkSession, source: str, path: str, clock, files_per_batch: int = 100, checkpoint: str | None = None, once: bool = True
) -> StreamingQuery:
    """Stream Parquet files of edges from ``source`` into the index at ``path``.

    ``clock(batch_id)`` gives the time of a batch. A batch that is replayed after a
    failure carries its old id and changes nothing. ``once`` works through what is
    there and stops.
    """
    tables = IndexTables(spark, path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        tables.merge(batch, clock(batch_id), batch_id=batch_id)

    stream = spark.readStream.schema(EDGE_BATCH).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or os.path.join(path, "_stream"))
    return (writer.trigger(availableNow=True) if once else writer).start()
