"""Index queries work a step out once, and leave nothing behind that nobody reads."""

import os
import random

import pytest
from test_graph import plain_rank

from webloom.operators import ranks as R
from webloom.plans import index as P


@pytest.fixture
def shop(spark, tmp_path):
    draw = random.Random(3)
    tables = {
        "customer": ("c_custkey long, c_nationkey int", [(i, i % 5) for i in range(20)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(i, i % 4) for i in range(8)]),
        "part": ("p_partkey long, p_name string", [(i, f"part {i}") for i in range(30)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, draw.randrange(20)) for i in range(60)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate string",
            [(draw.randrange(60), draw.randrange(30), draw.randrange(8), k % 7, 1.0 + k % 50, 0.01, 0.02, draw.choice("RAN"), f"1998-0{draw.randint(4, 8)}-02 00:00:00") for k in range(400)],
        ),
    }
    for name, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).selectExpr(*["CAST(l_shipdate AS TIMESTAMP) AS l_shipdate" if c.split()[0] == "l_shipdate" else c.split()[0] for c in columns.split(", ")]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_domain_pairs_are_worked_out_once(spark, shop, tmp_path, monkeypatch):
    folder = tmp_path / "shared"
    monkeypatch.setattr(R, "shared_dir", lambda _: str(folder))
    pairs = [tuple(r) for r in P.I.domain_edges(P.edges(spark, shop)).collect()]
    want = plain_rank(sorted({d for s, t, _ in pairs for d in (s, t)}), pairs, 0.85, 60)
    plans, pagerank = [], P.A.pagerank

    def watched(pairs):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return pagerank(pairs)

    monkeypatch.setattr(P.A, "pagerank", watched)
    got = {r.domain: r.pagerank for r in P.domain_pagerank(spark, shop).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Join" not in plans[0]
    left = sorted(n.split("-", 1)[1] for root in os.listdir(folder) for n in os.listdir(folder / root))
    assert left == ["pairs", "ranks"]
