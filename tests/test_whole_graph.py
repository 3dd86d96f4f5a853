"""Queries over the whole co-purchase graph, against brute force on a small order table."""

from collections import deque
from itertools import combinations

import pytest

from netlytics import queries as Q

# Pairs bought twice, none three times: two circles of different lengths joined by a path, and a pair apart.
LINKS = [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6), (6, 7), (7, 8), (6, 8), (20, 21)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("orders")
    lines = [(2 * i + k, p) for i, pair in enumerate(LINKS) for k in (0, 1) for p in pair]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{out}/lineitem.parquet")
    part = [(i, f"b{i % 3}", "t", 1.0 * i) for i in range(30)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_retailprice double").write.parquet(f"{out}/part.parquet")
    return str(out)


def searches():
    """(distances, numbers of shortest paths) from each node."""
    near = {}
    for s, t in LINKS:
        near.setdefault(s, []).append(t)
        near.setdefault(t, []).append(s)
    out = {}
    for start in near:
        dist, paths, todo = {start: 0}, {start: 1}, deque([start])
        while todo:
            u = todo.popleft()
            for v in near[u]:
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0
                    todo.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        out[start] = dist, paths
    return out


def test_distances_of_all_edges(spark, folder):
    found = searches()
    n = len(found)
    between = dict.fromkeys(found, 0.0)
    for s, t in combinations(found, 2):
        (ds, ps), (dt, pt) = found[s], found[t]
        for v in found:
            if t in ds and v in ds and v not in (s, t) and ds[v] + dt[v] == ds[t]:
                between[v] += ps[v] * pt[v] / ps[t]
    got = {int(r.id): r.betweenesscentrality for r in Q.QUERIES["betweenness"](spark, folder).collect()}
    assert got == {v: pytest.approx(x / ((n - 1) * (n - 2) / 2), abs=1e-8) for v, x in between.items()}
    close = {int(r.id): (r.closnesscentrality, r.harmonicclosnesscentrality, r.eccentricity) for r in Q.QUERIES["closeness"](spark, folder).collect()}
    far = {v: [d for d in dist.values() if d] for v, (dist, _) in found.items()}
    assert close == {v: pytest.approx((len(d) / sum(d), sum(1 / x for x in d) / (n - 1), max(d)), abs=1e-8) for v, d in far.items()}
    row = Q.QUERIES["path_length"](spark, folder).first()
    every = [d for x in far.values() for d in x]
    assert (row.average_path_length, row.diameter, row.radius) == (pytest.approx(sum(every) / len(every), abs=1e-8), max(every), min(max(d) for d in far.values()))


def test_louvain_of_the_whole_graph(spark, folder):
    """The query's graph has edges of all weights."""
    classes = {int(r.id): r.modularity_class for r in Q.QUERIES["louvain"](spark, folder).collect()}
    assert set(classes) == {v for pair in LINKS for v in pair}
    assert classes[20] == classes[21] != classes[1] and classes[6] == classes[7] == classes[8] != classes[1] and 1 < len(set(classes.values())) < len(classes)
