"""Yifan Hu by levels and overlap by grids of several widths, against brute force and a single level."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_paths import network, walks

from netlytics.operators import layout as L


def test_overlaps_of_all_widths(spark):
    """Narrow and wide nodes, one a thousand times wider than the rest, some on one spot, some without width."""
    r = random.Random(4)
    rows = [(f"{i:03}", r.uniform(-300, 300), r.uniform(-300, 300), 2 ** r.uniform(-2, 4)) for i in range(150)]
    rows += [("wide", 10.0, -20.0, 2000.0), ("same1", 5.0, 5.0, 1.0), ("same2", 5.0, 5.0, 1.0), ("thin1", 7.0, 7.0, 0.0), ("thin2", 7.0, 7.0, 0.0), ("far", 1e5, 1e5, 3.0)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and math.dist(a[1:3], b[1:3]) < a[3] + b[3]}
    got = [(x["id"], x["o"]) for x in L._overlaps(spark.createDataFrame(rows, "id string, x double, y double, w double")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_wide_node_has_nine_squares(spark):
    """Nodes far from each other are not compared because one is wide."""
    rows = [(f"{i:04}", 10.0 * (i % 40), 10.0 * (i // 40), 1.0) for i in range(1600)] + [("wide", -90000.0, 0.0, 50000.0)]
    assert L._overlaps(spark.createDataFrame(rows, "id string, x double, y double, w double")).isEmpty()


def test_matched(spark):
    """Pairs are neighbours; nodes of a star and of a path all find a group."""
    edges = [("hub", f"l{i}", True) for i in range(9)] + [(f"p{i:02}", f"p{i + 1:02}", True) for i in range(20)] + [("hub", "p00", True)]
    both = [(a, b, 1.0) for a, b, _ in edges] + [(b, a, 1.0) for a, b, _ in edges]
    rows = L.matched(spark.createDataFrame(both, "s string, t string, w double")).collect()
    group = {r["id"]: r["group"] for r in rows}
    assert len(rows) == len(group) == 31
    parts = {}
    for v, g in group.items():
        parts.setdefault(g, set()).add(v)
    assert all(len(p) > 1 and g in p for g, p in parts.items())
    near = {(a, b) for a, b, _ in both}
    for p in parts.values():  # each group is connected
        reached = {min(p)}
        while more := {b for a in reached for b in p - reached if (a, b) in near}:
            reached |= more
        assert reached == p


def stress(graph, far, k):
    at = {r["id"]: (r["x"], r["y"]) for r in graph.nodes.collect()}
    pairs = [(math.dist(at[a], at[b]), d) for a in far for b, d in far[a].items() if a < b]
    scale = sum(x / d for x, d in pairs) / sum(x * x / d / d for x, d in pairs)  # the scale of the picture does not count
    return sum((scale * x - d) ** 2 / d / d for x, d in pairs) / len(pairs)


def test_levels_have_less_stress_than_one(spark):
    edges = [(f"{i:03}", f"{(i + 1) % 120:03}", True) for i in range(120)]
    g = L.run_layout(network(spark, edges), "random").checkpoint()
    far = walks(edges, {v for a, b, _ in edges for v in (a, b)}, directed=False)
    c = L.YifanHu()
    levels, one = L.yifan_hu(g, c, 16, lambda: False, smallest=20), L.yifan_hu(g, c, 16, lambda: False, smallest=1000)
    assert stress(levels, far, 100) < 0.5 * stress(one, far, 100)
    assert levels.nodes.where("x IS NULL OR isnan(x)").isEmpty() and levels.nodes.count() == 120


def test_a_layout_at_rest_ends(spark):
    g = L.run_layout(network(spark, [("a", "b", True), ("b", "c", True)]), "random").checkpoint()
    rounds = []
    c = L.YifanHu(stepRatio=0.5)
    done = L.yifan_hu(g, c, 100, lambda: rounds.append(1) and False)
    assert len(rounds) < 2 * 60 and done.nodes.count() == 3
    assert L.yifan_hu(network(spark, [], ["z"]), c, 3, lambda: False).nodes.count() == 1
    assert done.nodes.agg(F.max(F.abs("x"))).first()[0] < 1e4


def test_steps():
    s = L._Steps(10.0, 0.5, 0.1)
    s.told(5.0)
    assert s.now == 10
    s.told(6.0)
    assert s.now == 5
    for e in (5, 4, 3, 2, 1):
        s.told(e)
    assert s.now == pytest.approx(10)
