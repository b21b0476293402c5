"""Queries on the stored index: the lines of the orders arrive in batches, as tables and as files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import index as I
from webloom.plans.index import IDX, RESULTS, links, written_links
from webloom.plans.registry import query, shaped
from webloom.session import shared_dir
from webloom.sources.index_tables import IndexTables
from webloom.streaming.index_stream import index_stream


def store(spark) -> IndexTables:
    return IndexTables(spark, os.path.join(shared_dir(spark), f"index-{uuid.uuid4().hex}"), parts=16)


def filled(spark, sf) -> tuple[IndexTables, list[tuple]]:
    """An index after three merges and a replay, and (merge, batch, new edges, edges, domains, pages) of each."""
    tables = store(spark)
    lines = written_links(spark, sf)
    again = lines[1].unionAll(lines[2]).where("target LIKE '%.com/p/1'")
    again = again.unionByName(again.withColumn("source", F.concat("source", F.lit("?again"))))
    events = I.classify_crawl(shaped(spark, sf, RESULTS))
    log = []
    for batch, rows, marks in ((1, lines[1], None), (2, lines[2], events), (2, lines[2], events), (3, again, None)):
        new = tables.merge(rows.drop("batch"), batch * 1000, batch_id=batch, events=marks, written=rows is not again)
        stored = tables.manifest()["tables"]
        log.append((len(log) + 1, batch, new, *[sum(n for _, n in stored[name].values()) for name in ("edges", "domains", "pages")]))
    tables.vacuum(keep=1)
    return tables, log


THIRD = IDX + """, old AS (SELECT source AS su, target AS tu, anchor, internal, nofollow, batch * 1000 AS now, batch * 1000000000000000 + seq AS o FROM raw),
late AS (SELECT su, tu, anchor, internal, nofollow, 3000 AS now, 3000000000000000 + o % 1000000000000000 AS o FROM old WHERE tu LIKE '%.com/p/1'),
every AS (SELECT * FROM old UNION ALL SELECT * FROM late UNION ALL SELECT su || '?again', tu, anchor, internal, nofollow, now, o FROM late),
final AS (SELECT su AS source_url, tu AS target_url, split_part(su, '/', 3) AS source_domain, split_part(tu, '/', 3) AS target_domain, arg_max(anchor, o) AS anchor,
  CAST(arg_min(internal, o) AS INT) AS internal, CAST(arg_max(nofollow, o) AS INT) AS nofollow, min(now) AS first_seen, max(now) AS last_seen FROM every GROUP BY 1, 2)"""


@query("index_merge_files", "WITH " + THIRD + " SELECT * FROM final")
def index_merge_files(spark, sf):
    return filled(spark, sf)[0].read("edges")


@query(
    "index_merge_log",
    "WITH " + THIRD + """, ev AS (SELECT domain FROM (""" + RESULTS + """)),
ends AS (SELECT split_part(su, '/', 3) AS d, now FROM every UNION ALL SELECT split_part(tu, '/', 3), now FROM every UNION ALL SELECT domain, 2000 FROM ev),
steps AS (SELECT * FROM (VALUES (1, 1, 1000), (2, 2, 2000), (3, 2, 2000), (4, 3, 3000)) t(merge, batch, now))
SELECT merge, batch, CASE WHEN merge = 3 THEN 0 ELSE (SELECT count(*) FROM final WHERE first_seen = s.now) END AS new_edges,
  (SELECT count(*) FROM final WHERE first_seen <= s.now) AS edges, (SELECT count(DISTINCT d) FROM ends WHERE ends.now <= s.now) AS domains,
  (SELECT count(DISTINCT su) FROM every WHERE every.now <= s.now) AS pages FROM steps s""",
)
def index_merge_log(spark, sf):
    log = filled(spark, sf)[1]
    return spark.createDataFrame(log, "merge int, batch int, new_edges long, edges long, domains long, pages long")


@query("index_stored_domains", "WITH " + IDX + " SELECT * FROM dom")
def index_stored_domains(spark, sf):
    tables = store(spark)
    tables.merge(links(spark, sf, 1).drop("batch"), 1000)
    tables.merge(links(spark, sf, 2).drop("batch"), 2000, events=I.classify_crawl(shaped(spark, sf, RESULTS)))
    return tables.read("domains")


@query(
    "index_stored_pages",
    "WITH " + IDX + """ SELECT source AS url, split_part(source, '/', 3) AS domain, min(batch) * 1000 AS first_seen, max(batch) * 1000 AS last_seen
FROM raw GROUP BY 1, 2""",
)
def index_stored_pages(spark, sf):
    tables = store(spark)
    for batch in (1, 2):
        tables.merge(links(spark, sf, batch).drop("batch"), batch * 1000)
    tables.resplit(24)
    return tables.read("pages")


def streamed(spark, sf) -> IndexTables:
    """The index after two runs of the stream, the files of a batch arriving before each."""
    tables = store(spark)
    source = tables.path + "-arrivals"
    for batch in (1, 2):
        links(spark, sf, batch).drop("batch").write.mode("append").parquet(source)
        run = index_stream(spark, source, tables.path, clock=lambda _, now=batch * 1000: now, files_per_batch=100_000)
        run.awaitTermination()
    return tables


@query("index_stream_files", "WITH " + IDX + " SELECT * FROM idx")
def index_stream_files(spark, sf) -> DataFrame:
    return streamed(spark, sf).read("edges")
