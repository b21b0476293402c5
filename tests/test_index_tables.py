"""Parts, manifests, concurrent writers and upkeep of the stored index."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from webloom.operators import index as I
from webloom.sources.index_tables import SCHEMAS, IndexTables
from webloom.sources.shared_files import SharedFiles
from webloom.streaming.index_stream import EDGE_BATCH

NAMES = [(f"http://s{i}.com/p", f"http://t{i % 7}.org/", f"a{i}", False, False, i) for i in range(300)]


def batch(spark, rows):
    return spark.createDataFrame(rows, EDGE_BATCH)


def folders(tables, name):
    return {p: folder for p, (folder, _) in tables.manifest()["tables"][name].items()}


def edges_of(df):
    return sorted(tuple(r) for r in df.select(*I.EDGE_COLUMNS).collect())


def test_a_merge_rewrites_only_the_parts_it_touches(spark, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"), parts=100)
    assert tables.merge(batch(spark, NAMES), 10) == 300
    before = {name: folders(tables, name) for name in SCHEMAS}
    assert tables.merge(batch(spark, [("http://s5.com/p", "http://t5.org/", "later", False, False, 1), ("http://s5.com/p", "http://new.org/", "n", False, False, 2)]), 20) == 1
    after = {name: folders(tables, name) for name in SCHEMAS}
    changed = {name: [p for p in after[name] if after[name][p] != before[name].get(p)] for name in SCHEMAS}
    assert len(changed["edges"]) == 1 and len(changed["pages"]) == 1 and len(changed["domains"]) <= 3 and not changed["meta"]
    written = tmp_path / "index" / "data" / after["edges"][changed["edges"][0]]
    assert [n for n in os.listdir(written) if n.startswith("part=")] == [f"part={changed['edges'][0]}"]
    want = I.merge_edges(I.merge_edges(spark.createDataFrame([], SCHEMAS["edges"]), batch(spark, NAMES), 10), batch(
        spark, [("http://s5.com/p", "http://t5.org/", "later", False, False, 1), ("http://s5.com/p", "http://new.org/", "n", False, False, 2)]), 20)
    assert edges_of(tables.read("edges")) == edges_of(want)


def test_reads_by_key_open_only_their_parts(spark, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"), parts=50)
    tables.merge(batch(spark, NAMES), 10)
    one = tables.read("pages", keys=["http://s7.com/p"])
    assert [r.domain for r in one.collect()] == ["s7.com"]
    assert len({os.path.dirname(f) for f in one.inputFiles()}) == 1
    assert tables.read("domains", keys=["t3.org", "nobody.org"]).count() == 1
    assert tables.read("domains", keys=["nobody.org"]).count() == 0


def test_old_versions_are_read_until_they_are_removed(spark, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"), parts=8)
    for i in range(4):
        tables.merge(batch(spark, NAMES[i * 10 : i * 10 + 10]), i)
    assert [tables.read("edges", version=v).count() for v in tables.versions()] == [10, 20, 30, 40]
    assert tables.vacuum(keep=2) > 0
    assert tables.versions() == [3, 4]
    assert [tables.read(n, version=3).count() for n in ("edges", "pages")] == [30, 30]
    assert tables.read("edges").count() == 40 and tables.vacuum(keep=2) == 0
    live = {f for v in (3, 4) for t in tables.manifest(v)["tables"].values() for f, _ in t.values()}
    stale = set(os.listdir(tmp_path / "index" / "data")) - live
    assert all(int(f.split("-")[1]) >= 3 for f in stale)


def test_a_name_is_given_once(spark, tmp_path):
    files, where = SharedFiles(spark), str(tmp_path / "deep" / "mark.json")
    assert files.create(where, "first ö") and not files.create(where, "second")
    assert files.read(where) == "first ö" and files.names(str(tmp_path / "deep")) == ["mark.json"]
    assert files.names(str(tmp_path / "nowhere")) == []


@pytest.mark.parametrize("rows", [NAMES[:20], NAMES[20:40]])
def test_a_writer_that_lost_merges_again(spark, tmp_path, rows):
    """Another writer takes the version between this one's read and its manifest."""
    path = str(tmp_path / "index")
    mine, other = IndexTables(spark, path, parts=4), IndexTables(spark, path, parts=4)
    mine.merge(batch(spark, NAMES[:20]), 1)
    write, turns = mine._write, []

    def late(*args):
        if not turns:
            turns.append(other.merge(batch(spark, rows + NAMES[50:52]), 2, batch_id=5, writer="other"))
        return write(*args)

    mine._write = late
    assert mine.merge(batch(spark, NAMES[30:52]), 3, batch_id=9, writer="mine") == len({r[0] for r in NAMES[30:52]} - {r[0] for r in rows + NAMES[50:52]})
    m = mine.manifest()
    assert m["version"] == 3 and m["batches"] == {"other": 5, "mine": 9}
    assert {r.source_url for r in mine.read("edges").collect()} == {r[0] for r in NAMES[:20] + rows + NAMES[30:52]}
    assert mine.merge(batch(spark, NAMES[100:110]), 4, batch_id=9, writer="mine") == 0


def test_writers_side_by_side(spark, tmp_path):
    path = str(tmp_path / "index")
    new, wrong = [], []

    def work(i):
        try:
            new.append(IndexTables(spark, path, parts=4).merge(batch(spark, NAMES[i * 20 : i * 20 + 30]), i, batch_id=1, writer=str(i)))
        except Exception as exc:  # noqa: BLE001
            wrong.append(exc)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    tables = IndexTables(spark, path)
    assert not wrong and sum(new) == 70 == tables.read("edges").count()
    assert tables.versions() == [1, 2, 3] and tables.manifest()["parts"] == 4


def test_a_large_part_has_several_files_and_resplit_keeps_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("webloom.sources.index_tables.FILE_ROWS", 25)
    rows = [("http://hub.com/", f"http://t{i}.org/", None, False, i % 2 == 0, i) for i in range(200)]
    tables = IndexTables(spark, str(tmp_path / "index"), parts=3)
    assert tables.merge(batch(spark, rows), 1) == 200
    assert len(tables.read("edges").inputFiles()) > 4
    before = {n: sorted(map(repr, tables.read(n).collect())) for n in SCHEMAS}
    assert tables.resplit(11) and tables.manifest()["parts"] == 11
    assert {n: sorted(map(repr, tables.read(n).collect())) for n in SCHEMAS} == before
    assert tables.merge(batch(spark, rows[:5] + [("http://hub.com/", "http://last.org/", "x", True, None, 1)]), 2) == 1


def test_empty_batches_and_null_ends(spark, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"))
    assert tables.merge(batch(spark, []), 1, batch_id=0) == 0
    assert tables.read("edges").collect() == [] and tables.versions() == [1]
    assert tables.merge(batch(spark, [(None, "http://a.com/", "x", True, True, 1), ("http://a.com/", "", "x", True, True, None)]), 2) == 0
    events = spark.createDataFrame([("alone.com", "failed", "timeout", 1, 5)], "domain string, status string, error string, seq long, now long")
    assert tables.merge(batch(spark, []), 3, events=events) == 0
    assert [(r.domain, r.attempts, r.last_error) for r in tables.read("domains").collect()] == [("alone.com", 1, "timeout")]
    assert tables.read("edges").agg(F.count("*")).first()[0] == 0


def test_a_merge_derives_its_addresses_once(spark, tmp_path, monkeypatch):
    from webloom.sources import index_tables

    labels, cut = [], index_tables.cut_lineage
    monkeypatch.setattr(index_tables, "cut_lineage", lambda df, label: labels.append(label) or cut(df, label))
    tables = IndexTables(spark, str(tmp_path / "index"), parts=4)
    path = str(tmp_path / "batch")
    batch(spark, NAMES).write.parquet(path)
    assert tables.merge(batch(spark, NAMES[:50]), 10) == 50
    assert labels == ["index-batch", "index-addresses"]
    # a written batch is not written again
    assert tables.merge(spark.read.parquet(path), 20, written=True) == 250
    assert labels[2:] == ["index-addresses"]
    assert tables.read("edges").count() == 300 and tables.read("pages").count() == 300 and tables.read("domains").count() == 307


def test_links_are_shuffled_once_and_sorted_after(spark):
    known = spark.createDataFrame([], SCHEMAS["edges"])
    for rows in (I.merge_edges(known, batch(spark, NAMES), 10), I.merge_edges(known, batch(spark, NAMES + NAMES), 10)):
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        before = plan[plan.index("RepartitionByExpression") if "RepartitionByExpression" in plan else plan.rindex("Exchange"):]
        assert "Aggregate" not in before
        assert rows.count() == 300


def test_rows_of_one_part_in_several_files_stay_one_edge_each(spark, tmp_path, monkeypatch):
    from webloom.sources import index_tables

    monkeypatch.setattr(index_tables, "FILE_ROWS", 20)
    tables = IndexTables(spark, str(tmp_path / "index"), parts=2)
    assert tables.merge(batch(spark, NAMES + NAMES), 10) == 300
    late = [(s, t, "late", False, True, 5) for s, t, *_ in NAMES]
    assert tables.merge(batch(spark, late), 20) == 0
    rows = tables.read("edges").collect()
    assert len(rows) == 300 and {(r.anchor, r.nofollow, r.first_seen, r.last_seen) for r in rows} == {("late", 1, 10, 20)}
