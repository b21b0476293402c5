"""Index merges, stored snapshots, streaming replays."""

from pyspark.sql import functions as F

from webloom.operators import index as I
from webloom.sources.index_tables import SCHEMAS, IndexTables
from webloom.streaming.index_stream import EDGE_BATCH, index_stream

E1 = [
    ("http://a.com/1", "http://b.com/1", "old", False, False, 1), ("http://a.com/1", "http://b.com/1", "new", True, True, 2),
    ("http://a.com/1", "http://a.com/2", "in", True, False, 3), ("", "http://b.com/1", "x", False, False, 4),
]
E2 = [("http://a.com/1", "http://b.com/1", "later", True, False, 1), ("http://c.com/1", "http://b.com/1", None, False, False, 2)]


def batch(spark, rows):
    return spark.createDataFrame(rows, EDGE_BATCH)


def test_merge_keeps_first_and_takes_latest(spark):
    m = I.merge_edges(spark.createDataFrame([], SCHEMAS["edges"]), batch(spark, E1), 10)
    m = I.merge_edges(m, batch(spark, E2), 20)
    rows = {(r.source_url, r.target_url): r for r in m.collect()}
    r = rows[("http://a.com/1", "http://b.com/1")]
    assert (r.anchor, r.internal, r.nofollow, r.first_seen, r.last_seen, r.is_new) == ("later", 0, 0, 10, 20, False)
    assert rows[("http://c.com/1", "http://b.com/1")].is_new and len(rows) == 3


def test_status_marks_only_rise(spark):
    d = spark.createDataFrame([("a.com", 1, 1)], "domain string, first_seen long, last_seen long")
    ev = [("a.com", "failed", "e1", 1, 5), ("a.com", "failed", "e2", 2, 6), ("a.com", "crawled", "", 3, 7), ("b.com", "offtopic", "", 4, 8)]
    out = I.fold_domain_status(d, spark.createDataFrame(ev, "domain string, status string, error string, seq long, now long"))
    out = I.fold_domain_status(out, spark.createDataFrame([("a.com", "failed", "x" * 400, 1, 9)], "domain string, status string, error string, seq long, now long"))
    rows = {r.domain: r for r in out.collect()}
    a = rows["a.com"]
    assert (a.first_seen, a.last_seen, a.crawled, a.attempts, a.last_error, a.offtopic) == (1, 9, 1, 3, "x" * 300, 0)
    assert (rows["b.com"].offtopic, rows["b.com"].attempts) == (1, 0)


def test_snapshots_and_replay(spark, tmp_path):
    t = IndexTables(spark, str(tmp_path / "index"))
    assert t.read("edges").count() == 0
    assert t.merge(batch(spark, E1), 10, batch_id=0) == 2
    assert t.merge(batch(spark, E1), 11, batch_id=0) == 0  # a replay changes nothing
    assert t.read("edges").agg(F.max("last_seen")).first()[0] == 10
    meta = spark.createDataFrame([("last_run", "20", 1)], "key string, value string, seq long")
    assert t.merge(batch(spark, E2), 20, batch_id=1, meta=meta) == 1
    assert I.get_meta(t.read("meta"), "last_run") == "20" and I.get_meta(t.read("meta"), "no", "d") == "d"
    assert sorted(r.domain for r in t.read("domains").collect()) == ["a.com", "b.com", "c.com"]
    assert t.merge(batch(spark, E1 + E2), 30) == 0


def test_stream_merges_files(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "index")
    batch(spark, E1).coalesce(1).write.parquet(src)
    index_stream(spark, src, path, clock=lambda b: 100 + b, files_per_batch=1).awaitTermination(120)
    batch(spark, E2).coalesce(1).write.mode("append").parquet(src)
    index_stream(spark, src, path, clock=lambda b: 100 + b, files_per_batch=1).awaitTermination(120)
    t = IndexTables(spark, path)
    assert t.read("edges").count() == 3
    assert sorted(r.url for r in t.read("pages").collect()) == ["http://a.com/1", "http://c.com/1"]
