"""Sampled betweenness, rewired graphs, power laws: against brute force on small graphs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_paths import network, random_edges

from netlytics.graph import GraphError, durable, flow, undirected
from netlytics.operators import statistics as S
from netlytics.operators.rewiring import random_like, rewired
from netlytics.operators.sampling import _searches, _shares, sampled_betweenness
from netlytics.plans import reports as R


def every_pair(edges, directed):
    """Share of the shortest paths of each ordered pair through each node, by listing the paths."""
    near = {}
    for a, b, d in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            if not (directed and d):
                near.setdefault(b, set()).add(a)
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    out = {}
    for s in nodes:
        for t in nodes:
            ways, seen = [[s]], {s}
            while s != t and ways and not any(w[-1] == t for w in ways):
                ways = [w + [u] for w in ways for u in near.get(w[-1], ()) if u not in seen]
                seen |= {w[-1] for w in ways}
            ways = [w for w in ways if s != t and w[-1] == t]
            out[s, t] = {v: n / len(ways) for v, n in Counter(v for w in ways for v in w[1:-1]).items()}
    return out


@pytest.mark.parametrize("directed", [False, True])
def test_every_pair_once(spark, directed):
    """The searches of all pairs, each drawn once, give exact betweenness; ways of equal length, loops, a pair of neighbours, parts without a way."""
    edges = random_edges(7, 22, 30, 0.7) + [("000", "000", True), ("x", "y", True)] + [(a, b, True) for a, b in ("qa", "qb", "ac", "bc", "cd")]
    g = network(spark, edges)
    want = every_pair(edges, directed)
    out = flow(g).where("s <> t").distinct() if directed else undirected(g)
    links = durable(out.select(F.lit(0).alias("side"), "s", "t").unionByName(out.select(F.lit(1).alias("side"), F.col("t").alias("s"), F.col("s").alias("t"))))
    pairs = [(i, s, t) for i, (s, t) in enumerate(k for k in want if k[0] != k[1])]
    found = _searches(links, spark.createDataFrame(pairs, "p long, s string, t string"))
    got = {r["v"]: r["q"] for r in _shares(links, found).groupBy("v").agg(F.sum("q").alias("q")).collect()}
    total = Counter()
    for shares in want.values():
        total.update(shares)
    assert set(got) == set(total)
    assert got == pytest.approx(dict(total))


@pytest.mark.parametrize("seed", [0, 1])
def test_error_holds(spark, seed):
    edges = random_edges(11, 40, 55) + [(f"s{i}", "hub", True) for i in range(15)] + [("hub", "000", True)]
    g = network(spark, edges, ["alone"])
    exact = {r["id"]: r["betweenesscentrality"] for r in S.distances(g)[0].collect()}
    values, told = sampled_betweenness(g, error=0.1, seed=seed)
    got = {r["id"]: r for r in values.collect()}
    assert set(got) == set(exact) and told["pairs"] > 100
    for v, b in exact.items():
        assert abs(got[v]["betweenesscentrality"] - b) <= got[v]["error"] <= 0.1 + 1e-9
    assert got["alone"]["betweenesscentrality"] == 0
    again = {r["id"]: r["betweenesscentrality"] for r in S.compute_betweenness(g, error=0.1, seed=seed)[0].nodes.collect()} if seed else {}
    assert all(again[v] == pytest.approx(got[v]["betweenesscentrality"]) for v in again)


def test_small_graphs_and_bad_errors(spark):
    g = network(spark, [("a", "b", True)])
    assert [r["betweenesscentrality"] for r in sampled_betweenness(g)[0].collect()] == [0.0, 0.0]
    with pytest.raises(GraphError):
        sampled_betweenness(g, error=0)


@pytest.mark.parametrize(("seed", "bin_edges"), [(0, 1000), (5, 20)])
def test_rewired(spark, monkeypatch, seed, bin_edges):
    monkeypatch.setattr("netlytics.operators.rewiring.BIN_EDGES", bin_edges)
    edges = random_edges(2, 50, 160) + [("hub", f"{i:03}", True) for i in range(40)] + [("001", "001", True)]
    g = network(spark, edges)
    before = {tuple(sorted((a, b))) for a, b, _ in edges if a != b}
    after = [tuple(r) for r in rewired(g, rounds=6, seed=seed).select("s", "t").collect()]
    assert len(after) == len(set(after)) == len(before) and all(a < b for a, b in after)
    count = lambda some: Counter(v for e in some for v in e)
    assert count(after) == count(before)
    assert len(set(after) & before) < 0.6 * len(before)
    assert sorted(after) == sorted(tuple(r) for r in rewired(g, rounds=6, seed=seed).select("s", "t").collect())


def test_rewiring_what_cannot_change(spark):
    """A star, a triangle and a graph without edges have no swap."""
    star = network(spark, [("hub", f"{i}", True) for i in range(6)])
    assert {tuple(r) for r in rewired(star, rounds=2).select("s", "t").collect()} == {(f"{i}", "hub") for i in range(6)}
    assert random_like(network(spark, [], ["a"]), rounds=1).edges.count() == 0


def test_small_world_of_a_ring(spark):
    """A ring of neighbours has the clustering that a random graph of its degrees loses."""
    told = R.small_world_sample(network(spark, [(f"{i:03}", f"{(i + k) % 80:03}", True) for i in range(80) for k in (1, 2, 3)]), rounds=6)
    assert told["clustering"] == pytest.approx(0.6)
    assert told["random_clustering"] < 0.3 and told["random_path_length"] < told["path_length"] and told["sigma"] > 1.2 and told["changed"] > 0.5


def fitted(degrees):
    best = None
    for cut in sorted(set(degrees))[:-1]:
        tail = [x for x in degrees if x >= cut]
        low = cut - 0.5
        a = 1 + len(tail) / sum(math.log(x / low) for x in tail)
        gap = max(max(abs(sum(y >= x for y in tail) / len(tail) - ((x - 0.5) / low) ** (1 - a)), abs(sum(y > x for y in tail) / len(tail) - ((x + 0.5) / low) ** (1 - a))) for x in set(tail))
        if best is None or gap < best[2] - 1e-12:
            rate = 1 / (sum(tail) / len(tail) - low)
            gains = [math.log((a - 1) / low) - a * math.log(x / low) - math.log(rate) + rate * (x - low) for x in tail]
            mean = sum(gains) / len(gains)
            best = (a, cut, gap, len(tail), len(set(tail)), sum(gains), sum(gains) / math.sqrt(sum((v - mean) ** 2 for v in gains)))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_power_law(spark, seed):
    r = random.Random(seed)
    edges, ends = [], ["000", "001"]
    for i in range(2, 150):  # new nodes choose old ones by their degrees
        for _ in range(2):
            other = r.choice(ends)
            if other != f"{i:03}":
                edges.append((f"{i:03}", other, True))
                ends += [f"{i:03}", other]
    g = network(spark, edges)
    want = fitted(list(Counter(v for a, b, _ in edges for v in (a, b)).values()))
    row = R.power_law(g).first()
    assert [row[c] for c in ("exponent", "cut_off", "distance", "tail_nodes", "points", "likelihood_ratio", "vuong")] == pytest.approx(list(want))


def test_no_power_law(spark):
    assert R.power_law(network(spark, [], ["a"])).count() == 0
    ring = network(spark, [(f"{i}", f"{(i + 1) % 5}", True) for i in range(5)])
    assert R.power_law(ring).count() == 0  # one degree only
