"""Communities by independent moves."""

import random

import pytest
from pyspark.sql import functions as F

from netlytics.graph import Graph, edge_frame, node_frame
from netlytics.operators import communities as C


def network(spark, edges, nodes=()):
    ids = sorted({v for e in edges for v in e} | set(nodes))
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "seq long, source string, target string")
    return Graph(node_frame(spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "id string, seq long")), edge_frame(e)).checkpoint()


def modularity(edges, c, resolution=1.0):
    m = len(edges)
    inside = sum(c[a] == c[b] for a, b in edges) / m
    degree = {}
    for a, b in edges:
        for v in (a, b):
            degree[c[v]] = degree.get(c[v], 0) + 1
    return inside - resolution * sum((k / (2 * m)) ** 2 for k in degree.values())


def random_edges(seed, n, m, groups=4):
    r = random.Random(seed)
    out = [(f"{a:03}", f"{b:03}") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m * 8)) if a != b and (a % groups == b % groups or r.random() < 0.12)]
    return out[:m]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_moves_of_a_round_are_independent(spark, seed):
    """From any partition, modularity rises by the gains of a round's moves at least."""
    edges = random_edges(seed, 40, 160)
    g = network(spark, edges)
    r = random.Random(seed)
    nodes = [row["id"] for row in g.nodes.select("id").collect()]
    c = {v: r.choice(nodes) for v in nodes} if seed > 1 else {v: v for v in nodes}
    both = edges + [(b, a) for a, b in edges]
    links = spark.createDataFrame([(a, b, 1.0) for a, b in both], "s string, t string, w double").groupBy("s", "t").agg(F.sum("w").alias("w"))
    total = float(len(both))
    k = {v: float(sum(a == v for a, _ in both)) for v in nodes}
    for _ in range(4):
        now = spark.createDataFrame([(v, k[v], c[v]) for v in nodes], "id string, k double, c string")
        made = C._made(links, C._wishes(links, now, total, 1.0), total, 1.0).collect()
        new = c | {row["id"]: row["to"] for row in made}
        assert made or c == new
        assert modularity(edges, new) >= modularity(edges, c) + 2 * sum(row["gain"] for row in made) / total - 1e-12
        c = new


def test_two_cliques_and_a_node_alone(spark):
    edges = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    classes = {}
    for r in C.louvain(network(spark, edges, ["z"])).collect():
        classes.setdefault(r.community, set()).add(r.id)
    assert sorted(len(v) for v in classes.values()) == [1, 5, 5] and {"z"} in classes.values()
    assert all(len({v[0] for v in members}) == 1 for members in classes.values())


def test_known_groups_and_resolution(spark):
    """At least as good as the groups the graph was made from; finer with a higher resolution; every community is connected."""
    edges = random_edges(7, 80, 400)
    g = network(spark, edges)
    found = {r.id: r.community for r in C.louvain(g).collect()}
    assert modularity(edges, found) >= modularity(edges, {v: int(v) % 4 for v in found}) - 0.01
    fine = {r.id: r.community for r in C.louvain(g, resolution=4.0).collect()}
    assert len(set(fine.values())) > len(set(found.values()))
    for c in (found, fine):
        for name in set(c.values()):
            members = {v for v in c if c[v] == name}
            reached, todo = set(), [min(members)]
            while todo:
                v = todo.pop()
                reached.add(v)
                todo += [b if a == v else a for a, b in edges if v in (a, b) and {a, b} <= members and not {a, b} <= reached]
            assert reached == members


def test_unconnected_communities_are_split(spark):
    edges = [("a", "b"), ("c", "d"), ("d", "e")]
    links = spark.createDataFrame([(x, y, 1.0) for a, b in edges for x, y in ((a, b), (b, a))], "s string, t string, w double")
    member = spark.createDataFrame([(v, "one") for v in "abcd"] + [("e", "two")], "id string, c string")
    found = {r["id"]: r["c"] for r in C._connected(links, member).collect()}
    assert found["a"] == found["b"] != found["c"] == found["d"] != found["e"]


def test_graphs_without_links(spark):
    alone = network(spark, [("x", "x")], ["a", "b"])
    assert sorted(r["community"] for r in C.louvain(alone).collect()) == ["a", "b", "x"]
    empty = network(spark, [], ["a"])
    assert [tuple(r) for r in C.louvain(empty).collect()] == [("a", "a")]
