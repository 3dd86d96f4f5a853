"""Strong components, sketched distances, bounds of paths: against brute force on small graphs."""

import random

import pytest

from netlytics.graph import Graph, edge_frame, node_frame
from netlytics.operators import paths as P
from netlytics.operators.components import strong_components


def network(spark, edges, nodes=()):
    """Edges (source, target, directed)."""
    ids = sorted({v for a, b, _ in edges for v in (a, b)} | set(nodes))
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "seq long, source string, target string, directed boolean")
    return Graph(node_frame(spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "id string, seq long")), edge_frame(e)).checkpoint()


def walks(edges, nodes, directed=True):
    """Distances of all pairs."""
    out = {}
    near = {v: set() for v in nodes}
    for a, b, d in edges:
        if a != b:
            near[a].add(b)
            if not (directed and d):
                near[b].add(a)
    for v in nodes:
        dist, layer = {v: 0}, [v]
        while layer:
            layer = [u for w in layer for u in near[w] if u not in dist and not dist.update({u: dist[w] + 1})]
        out[v] = dist
    return out


def random_edges(seed, n, m, share=1.0):
    r = random.Random(seed)
    return [(f"{r.randrange(n):03}", f"{r.randrange(n):03}", r.random() < share) for _ in range(m)]


@pytest.mark.parametrize(("seed", "share"), [(1, 1.0), (2, 0.9)])
def test_strong_components(spark, seed, share):
    """Random directed graphs near the point where cycles appear, with loops, repeated and undirected edges, a long cycle, a long path, a node alone."""
    edges = random_edges(seed, 60, 80, share) + [("000", "000", True)] * 2
    edges += [(f"c{i}", f"c{(i + 1) % 12:d}", True) for i in range(12)] + [(f"p{i}", f"p{i + 1}", True) for i in range(9)]
    g = network(spark, edges, ["alone"])
    nodes = {v for a, b, _ in edges for v in (a, b)} | {"alone"}
    far = walks(edges, nodes)
    want = {v: min(u for u in far[v] if v in far[u]) for v in nodes}
    assert {r["id"]: r["component"] for r in strong_components(g).collect()} == want
    assert len(set(want.values())) < len(nodes) - 12


def test_strong_components_of_a_path_and_of_nothing(spark):
    path = network(spark, [("a", "b", True), ("b", "c", True)])
    assert {r["id"]: r["component"] for r in strong_components(path).collect()} == {"a": "a", "b": "b", "c": "c"}
    assert strong_components(network(spark, [], ["z"])).collect()[0]["component"] == "z"


@pytest.mark.parametrize("batch", [2, 16])
def test_path_bounds(spark, batch):
    """Several components, one of them a long path with a bush at its end."""
    edges = random_edges(3, 70, 75) + [(f"p{i:02}", f"p{i + 1:02}", True) for i in range(14)] + [("p14", f"q{i}", True) for i in range(5)]
    g = network(spark, edges, ["alone"])
    far = walks(edges, {v for a, b, _ in edges for v in (a, b)}, directed=False)
    ecc = [max(d.values()) for d in far.values() if len(d) > 1]
    found = P.path_bounds(g, batch=batch)
    assert (found["diameter"], found["radius"]) == (max(ecc), min(ecc))
    assert 0 < found["searches"] < len(far)


def test_paths_without_links(spark):
    g = network(spark, [("a", "a", True)], ["b"])
    assert P.path_bounds(g) == {"diameter": 0, "radius": 0, "searches": 0}
    values, scalars = P.sketched_distances(g)
    assert scalars == {"average_path_length": 0.0, "diameter": 0}
    assert {tuple(r) for r in values.collect()} == {("a", 0.0, 0.0, 0.0, 0), ("b", 0.0, 0.0, 0.0, 0)}


@pytest.mark.parametrize("directed", [False, True])
def test_sketched_distances(spark, directed):
    """Small neighbourhoods are counted exactly."""
    edges = random_edges(5, 50, 70, 0.8)
    g = network(spark, edges)
    nodes = {v for a, b, _ in edges for v in (a, b)}
    far = walks(edges, nodes, directed)
    values, scalars = P.sketched_distances(g, directed=directed)
    got = {r["id"]: r for r in values.collect()}
    for v, dist in far.items():
        d = [x for x in dist.values() if x]
        assert got[v]["reached"] == pytest.approx(len(d), rel=0.05)
        assert got[v]["closnesscentrality"] == pytest.approx(len(d) / sum(d) if d else 0.0, rel=0.05)
        assert got[v]["harmonicclosnesscentrality"] == pytest.approx(sum(1 / x for x in d) / (len(nodes) - 1), rel=0.05)
    every = [x for dist in far.values() for x in dist.values() if x]
    assert scalars["average_path_length"] == pytest.approx(sum(every) / len(every), rel=0.03)
    assert scalars["diameter"] == max(every)
