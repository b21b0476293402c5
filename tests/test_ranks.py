"""PageRank of many graphs at once against plain Python, graph by graph."""

import os
import random
import time

import pytest

from test_graph import plain_rank
from webloom.operators import ranks as R
from webloom.session import FREE_SHUFFLES, freeing

EDGES, NODES = "site string, src string, dst string, w int", "site string, node string"


def graphs():
    """Sites of all sizes: one holds a third of the pages, one has a single page, one no links at all."""
    draw = random.Random(11)
    out = {}
    for i, size in enumerate([60, 1, 5, 2, 30, 40, 9, 12, 21]):
        names = [f"p{k}" for k in range(size)]  # the same names on every site
        pairs = {(a, b): draw.randint(1, 3) for a, b in (draw.sample(names, 2) for _ in range(size * 2)) if a not in ("p1", "p2")} if size > 2 else {}
        out[f"site{i}"] = names, [(a, b, w) for (a, b), w in pairs.items()]
    out["site0"][1].extend(("p0", t, 2) for t in out["site0"][0][1:] if ("p0", t) not in {e[:2] for e in out["site0"][1]})
    return out


def frames(spark, web):
    edges = [(s, *e) for s, (_, es) in web.items() for e in es]
    return spark.createDataFrame(edges, EDGES).repartition(3), spark.createDataFrame([(s, n) for s, (ns, _) in web.items() for n in ns], NODES).repartition(3)


@pytest.mark.parametrize("slice_edges, rounds", [(1_000_000, 8), (4, 3)])
def test_every_graph_as_if_alone(spark, monkeypatch, slice_edges, rounds):
    monkeypatch.setattr(R, "SLICE_EDGES", slice_edges)
    web = graphs()
    got = {(r.site, r.node): r["rank"] for r in R.graph_ranks(*frames(spark, web), iterations=7, rounds=rounds).collect()}
    want = {(s, n): x for s, (ns, es) in web.items() for n, x in plain_rank(ns, es, 0.85, 7).items()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_stops_after_the_first_round_below_the_tolerance(spark):
    names, edges = graphs()["site4"]
    last, need = plain_rank(names, edges, 0.85, 0), None
    for i in range(1, 60):
        now = plain_rank(names, edges, 0.85, i)
        if sum(abs(now[n] - last[n]) for n in names) < 1e-4:
            need = i
            break
        last = now
    web = {"x": (names, edges)}
    for rounds in (1, 4):
        got = {r.node: r["rank"] for r in R.graph_ranks(*frames(spark, web), iterations=60, tol=1e-4, rounds=rounds).collect()}
        want = plain_rank(names, edges, 0.85, need)
        assert max(abs(got[n] - want[n]) for n in names) < 1e-13


def test_only_the_result_stays_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "shared_dir", lambda _: str(tmp_path))
    R.graph_ranks(*frames(spark, {"x": (["a", "b"], [("a", "b", 1)])}), iterations=5, rounds=2).collect()
    (root,) = os.listdir(tmp_path)
    assert [n.split("-")[1] for n in os.listdir(tmp_path / root)] == ["ranks"]


def test_no_nodes_and_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert R.graph_ranks(none, spark.createDataFrame([], NODES)).collect() == []
    some = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], NODES)
    assert sorted((r.site, r.node, round(r["rank"], 9)) for r in R.graph_ranks(none, some, iterations=3).collect()) == [("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 1.0)]


def test_scaled_per_site(spark):
    visited = spark.createDataFrame([("a", "/1"), ("a", "/2"), ("b", "/1"), ("b", "/2"), ("b", "/3")], "site string, url string")
    rows = [("a", "/1", "/2", True, False), ("b", "/1", "/3", True, False), ("b", "/2", "/3", True, False), ("b", "/3", "/1", True, True), ("b", "/3", "/9", True, False), ("b", "/1", "/1", True, False)]
    edges = spark.createDataFrame(rows, "site string, source string, target string, internal boolean, nofollow boolean")
    got = {(r.site, r.url): r.pagerank for r in R.site_pagerank(visited, edges).collect()}
    for site, names, links in (("a", ["/1", "/2"], [("/1", "/2", 1)]), ("b", ["/1", "/2", "/3"], [("/1", "/3", 1), ("/2", "/3", 1)])):
        want = plain_rank(names, links, 0.85, 40)
        assert all(abs(got[site, n] - 100 * want[n] / max(want.values())) < 0.051 for n in names)


def test_rounds_carry_numbers_only(spark, monkeypatch):
    seen = []
    write = R.Workspace.write

    def watched(self, df, name):
        if name == "round":
            seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(R.Workspace, "write", watched)
    edges = spark.createDataFrame([("x", "a", "b", 1), ("x", "b", "c", 1), ("x", "c", "a", 1), ("x", "c", "b", 1)], "site string, src string, dst string, w int")
    nodes = spark.createDataFrame([("x", n) for n in "abcd"], "site string, node string")
    got = {r.node: r["rank"] for r in R.graph_ranks(edges, nodes, iterations=5, rounds=2).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["b"] > got["d"]
    assert [len(columns) for columns, _ in seen] == [2, 2, 2]
    assert all("SortAggregate" not in plan for _, plan in seen)


def shuffles(spark) -> set[str]:
    """The shuffles that have files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


@pytest.mark.parametrize("tol", [None, 1e-12])
def test_large_graphs_take_one_round_a_job(spark, monkeypatch, tol):
    written, seen, made = [], R.Workspace.write, []

    def watched(self, df, name):
        before = shuffles(spark)
        path = seen(self, df, name)
        made.append((name, shuffles(spark) - before))
        written.append((name, len(df.sparkSession.read.parquet(path).collect())))
        return path

    web = graphs()
    few, rounds = frames(spark, web), 6
    monkeypatch.setattr(R, "JOB_ROWS", 0)
    monkeypatch.setattr(R.Workspace, "write", watched)
    got = {(r.site, r.node): r["rank"] for r in R.graph_ranks(*few, iterations=rounds, tol=tol).collect()}
    want = {(s, n): x for s, (ns, es) in web.items() for n, x in plain_rank(ns, es, 0.85, rounds).items()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert [name for name, _ in written].count("round") == rounds
    # the cached shares and nodes are shuffled in the first round and keep their files; those of later rounds go soon after their job
    gone = set().union(*[new for name, new in made if name == "round"][1:])
    until = time.time() + 20
    while shuffles(spark) & gone and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) & gone, [(name, new & shuffles(spark)) for name, new in made]
    # a mass has no row for each of its pages
    (shares,) = (n for name, n in written if name == "shares")
    edges, pages = few[0].count(), few[1].count()
    assert shares - (pages if tol else 0) < edges + pages
    assert spark.conf.get(FREE_SHUFFLES, "false") == "false"


def test_the_setting_of_shuffle_files_comes_back_after_blocks_that_overlap(spark):
    setting = spark.conf.get(FREE_SHUFFLES, None)
    one, two = freeing(spark), freeing(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(FREE_SHUFFLES) == "true"
    two.__exit__(None, None, None)
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
