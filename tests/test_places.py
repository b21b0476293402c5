"""Numbers inside groups, report pairing and walks that rest on them."""

from pyspark.sql import functions as F

from webloom.operators import diff as D
from webloom.operators import graph as G
from webloom.operators.places import numbered


def test_numbers_follow_the_order_in_every_group(spark):
    # one group holds a third of all rows, and its ids share one long prefix
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("team"),
        F.concat(F.lit("same-prefix-"), F.lpad(F.col("id") * 7919 % 3001, 6, "0")).alias("name"), F.col("id").alias("place_before"))
    got = numbered(rows, ["team"], ["name"]).collect()
    by_team = {}
    for r in sorted(got, key=lambda r: r.name):
        by_team.setdefault(r.team, []).append(r.place)
    assert len(got) == 3000 and None in by_team
    assert all(places == list(range(1, len(places) + 1)) for places in by_team.values())


def test_a_hot_group_is_numbered_by_many_tasks(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("team"), F.concat(F.lit("00"), F.lpad("id", 8, "0")).alias("name"))
    spread = rows.repartitionByRange(8, "team", "name").groupBy(F.spark_partition_id()).count()
    assert spread.count() == 8 and spread.agg(F.max("count")).first()[0] < 5000
    out = numbered(rows, ["team"], ["name"])
    assert out.where(F.col("name") != F.concat(F.lit("00"), F.lpad(F.col("place") - 1, 8, "0"))).count() == 0


def test_numbers_of_an_empty_table(spark):
    assert numbered(spark.createDataFrame([], "team string, name string"), ["team"], ["name"]).collect() == []


def test_moved_findings_of_one_large_shape_pair_in_id_order(spark):
    columns = "id string, severity string, category string, title string, url string, element string, seq long"
    make = lambda ids, url: spark.createDataFrame([(f"ff{i:04d}", "low", None, "Same", f"{url}/{i}", None, i) for i in ids], columns)
    old, new = make(range(0, 300), "http://o.test"), make(range(200, 450), "http://n.test")
    rows = {r.id: r for r in D.diff(old, new).collect()}
    want = dict(zip([f"ff{i:04d}" for i in range(300, 450)], range(150), strict=False))
    assert {i for i, r in rows.items() if r.change == "moved"} == set(want)
    assert all(rows[i].was_url == f"http://o.test/{n}" for i, n in want.items())
    assert {i for i, r in rows.items() if r.change == "fixed"} == {f"ff{i:04d}" for i in range(150, 200)}
    assert sum(r.change == "unchanged" for r in rows.values()) == 100


def test_walk_with_a_full_filter_is_the_same(spark, monkeypatch):
    edges = [(f"http://a.test/{s}", f"http://a.test/{(s * 3 + k) % 60}", k) for s in range(60) for k in range(4)]
    edges += [("http://a.test/", f"http://a.test/{k}", k) for k in (5, 9)] + [("http://a.test/9", "http://a.test/", 9)]
    df = spark.createDataFrame(edges, "source string, target string, seq int")
    seeds = spark.createDataFrame([("http://a.test/", 0), ("http://a.test/", 1)], "url string, seq int")
    plain = sorted(map(tuple, G.reach(df, seeds, 6, 40).collect()))
    monkeypatch.setattr(G, "FILTER_WORDS", 1)
    assert sorted(map(tuple, G.reach(df, seeds, 6, 40).collect())) == plain
    assert sorted(p for _, _, p, _ in plain) == list(range(1, len(plain) + 1)) and len(plain) == 40
