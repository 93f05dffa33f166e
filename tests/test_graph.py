"""Components of graphs that are contracted before a task sees them."""

import random

import pytest

from plumbline.operators import graph


def sccs(edges):
    found = graph.tarjan(edges)
    size = {}
    for s in found.values():
        size[s] = size.get(s, 0) + 1
    loops = {a for a, b in edges if a == b}
    return sorted((n, s) for n, s in found.items() if size[s] > 1 or n in loops)


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long").repartition(3)


def got(df):
    return sorted((r.node, r.scc) for r in df.select("node", "scc").collect())


@pytest.mark.parametrize("seed", range(4))
def test_contracted_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(70), r.randrange(70)) for _ in range(90)]  # some cycles, some chains, some loops
    edges += [(100, 101), (101, 102), (102, 103), (103, 100), (200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (204, 202), (204, 3), (4, 200)]
    assert got(graph.strong_components(frame(spark, edges), most=0)) == sccs(edges)


def test_rounds_do_not_grow_with_a_path(spark, monkeypatch):
    tables = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (tables.append(name), keep(df, name))[1])
    path = spark.range(100_000).selectExpr("id AS a", "id + 1 AS b").repartition(4)
    extra = frame(spark, [(100_000, 200_000), (200_000, 0), (200_000, 300_000), (300_000, 300_001)])  # closed far away
    assert graph.strong_components(path, most=0).isEmpty()
    assert len(tables) < 60
    tables.clear()
    ring = graph.strong_components(path.unionByName(extra), most=0)
    assert ring.count() == 100_002 and ring.select("scc").distinct().count() == 1
    assert len(tables) < 60


def test_a_chain_of_cycles_is_not_walked(spark, monkeypatch):
    monkeypatch.setattr(graph, "coloured", lambda edges: pytest.fail("labels were passed along the chain"))
    r = random.Random(8)
    edges = [(12 * d + k, 12 * d + (k + 1) % 12) for d in range(300) for k in range(12)] + [(12 * d + r.randrange(12), 12 * (d + 1) + r.randrange(12)) for d in range(300) for _ in range(3)]
    assert got(graph.strong_components(frame(spark, edges), most=40)) == sccs(edges)


def test_a_long_layered_graph_is_cut_by_its_order(spark, monkeypatch):
    monkeypatch.setattr(graph, "contracted", lambda edges, most: pytest.fail("a layered graph was contracted"))
    monkeypatch.setattr(graph, "ONE_TASK", 100)
    r = random.Random(9)
    edges = [(12 * d + r.randrange(12), 12 * d + r.randrange(12)) for d in range(400) for _ in range(14)] + [(k, k + 12) for k in range(4800)]
    edges += [(5000, 5001), (5001, 5002), (5002, 5003), (5003, 5001), (5002, 5000)]  # nested and touching ways back
    assert got(graph.strong_components(frame(spark, edges), most=500)) == sccs(edges)
    cut = graph.within_islands(frame(spark, edges))
    assert cut.filter("b = a + 12").isEmpty() and cut.filter("a >= 5000").count() == 5
    assert graph.within_islands(frame(spark, edges).limit(0)).isEmpty()
