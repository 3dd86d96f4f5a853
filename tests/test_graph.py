import pytest
from pyspark.sql import functions as F

from netlytics.graph import Graph, edge_frame, from_edges, node_frame, with_seq
from netlytics.operators import appearance as A
from netlytics.operators import edit as E
from netlytics.operators import filters as FI
from netlytics.operators import query as Q
from netlytics.operators import statistics as S

GRAPHS = {
    "barbell": "ab bc ca cd de ef fd",
    "star5": "ab ac ad ae",
    "path4": "ab bc cd",
    "cycle4": "ab bc cd da",
    "k4": "ab ac ad bc bd cd",
    "split": "ab bc de f",
}


def graph(spark, name) -> Graph:
    parts = GRAPHS[name].split()
    ids = sorted({c for p in parts for c in p})
    nodes = node_frame(spark.createDataFrame([(c, i) for i, c in enumerate(ids)], "id string, seq long"))
    edges = edge_frame(spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate(parts) if len(p) == 2], "seq long, source string, target string"))
    return Graph(nodes, edges)


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize(("name", "density", "degree", "count"), [("barbell", 0.466667, 2.333333, 1), ("star5", 0.4, 1.6, 1), ("split", 0.2, 1.0, 3)])
def test_summary(spark, name, density, degree, count):
    g = graph(spark, name)
    row = Q.graph_stats(g).first()
    assert (round(row.density, 6), round(row.average_degree, 6)) == (density, degree)
    assert S.compute_connected_components(g)[1] == {"connected_components": count}


@pytest.mark.parametrize(
    ("name", "apl", "diameter", "radius", "between", "close", "harmonic"),
    [
        ("barbell", 1.8, 3, 2, {"c": 6, "d": 6, "a": 0}, {"c": 0.714286, "a": 0.5}, {"c": 0.8, "a": 0.633333}),
        ("path4", 1.666667, 3, 2, {"b": 2, "c": 2, "a": 0}, {"a": 0.5, "b": 0.75}, {"a": 0.611111, "b": 0.833333}),
        ("cycle4", 1.333333, 2, 2, dict.fromkeys("abcd", 0.5), {"a": 0.75}, {"a": 0.833333}),
        ("split", 1.25, 2, 1, {"b": 1, "f": 0}, {"a": 0.666667, "b": 1, "f": 0}, {"a": 0.3, "b": 0.4, "d": 0.2, "f": 0}),
    ],
)
@pytest.mark.parametrize("shared", [True, False])
def test_distances(spark, name, apl, diameter, radius, between, close, harmonic, shared):
    if not shared and name not in ("barbell", "split"):
        pytest.skip("one long and one broken graph are enough for the joins")
    df, scalars = S.distances(graph(spark, name), normalized=False, shared=shared)
    rows = {r["id"]: r for r in df.collect()}
    assert (round(scalars["average_path_length"], 6), scalars["diameter"], scalars["radius"]) == (apl, diameter, radius)
    for want, column in ((between, "betweenesscentrality"), (close, "closnesscentrality"), (harmonic, "harmonicclosnesscentrality")):
        for k, v in want.items():
            assert round(rows[k][column], 6) == v


@pytest.mark.parametrize(("name", "want"), [("barbell", {"a": 0.064471, "d": 0.268862}), ("split", {"a": 0.107846, "b": 0.199515, "c": 0.277433})])
def test_pagerank(spark, name, want):
    got = values(S.pagerank(graph(spark, name), rounds=20, tolerance=0), "pageranks")
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(round(got[k], 6) == v for k, v in want.items())


def test_clustering(spark):
    assert round(S.compute_clustering_coefficient(graph(spark, "barbell"))[1]["average_clustering_coefficient"], 6) == 0.777778
    assert set(values(S.clustering(graph(spark, "k4")), "clustering").values()) == {1.0}


def test_modularity(spark):
    g = graph(spark, "barbell")
    halves = spark.createDataFrame([(c, int(c > "c")) for c in "abcdef"], "id string, community int")
    assert round(S.modularity_score(g, halves).first()[0], 6) == 0.357143
    assert round(S.modularity_score(g, halves, 2.0).first()[0], 6) == -0.142857
    found, scalars = S.compute_modularity(g)
    assert round(scalars["modularity"], 6) == 0.357143
    groups = values(found.nodes, "modularity_class")
    assert groups["a"] == groups["b"] == groups["c"] != groups["d"] == groups["e"] == groups["f"]


def test_hits_and_eigenvector_have_their_ranges(spark):
    g = graph(spark, "star5")
    h = S.hits(g, rounds=5).collect()
    assert max(r["Hub"] for r in h) == 1 and all(0 <= r["Authority"] <= 1 for r in h)
    assert max(values(S.eigenvector(g, rounds=5), "eigencentrality").values()) == 1


def test_iterations_end_at_their_tolerance(spark):
    """A tolerance ends them with the first round that moves less, as plain loops do."""
    g = graph(spark, "k4")
    links = [(r.source, r.target) for r in g.edges.collect()]
    v = dict.fromkeys("abcd", 1.0)
    for _ in range(100):
        raw = {i: v[i] + sum(v[s] for s, t in links if t == i) for i in v}
        new = {i: x / max(raw.values()) for i, x in raw.items()}
        moved, v = max(abs(new[i] - v[i]) for i in v), new
        if moved < 0.05:
            break
    assert values(S.eigenvector(g, tolerance=0.05), "eigencentrality") == pytest.approx(v)
    h, a = dict.fromkeys("abcd", 1.0), dict.fromkeys("abcd", 1.0)
    for _ in range(100):
        a1 = {i: sum(h[s] for s, t in links if t == i) for i in h}
        h1 = {i: sum(a1[t] for s, t in links if s == i) for i in h}
        na, nh = (sum(x * x for x in d.values()) ** 0.5 for d in (a1, h1))
        moved = sum(abs(a1[i] / na - a[i]) for i in a)
        h, a = {i: x / nh for i, x in h1.items()}, {i: x / na for i, x in a1.items()}
        if moved < 0.01:
            break
    got = S.hits(g, tolerance=0.01).collect()
    assert {r.id: r.Authority for r in got} == pytest.approx(a) and {r.id: r.Hub for r in got} == pytest.approx(h)
    nothing = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert [f(nothing).count() for f in (S.pagerank, S.hits, S.eigenvector)] == [0, 0, 0]


def test_edits(spark):
    g = graph(spark, "path4")
    g, counts = E.add_nodes(g, [{"id": "x"}, {"id": "x", "label": "again"}, {"id": "a"}, {"id": None}, {"id": "y", "label": None, "attributes": {"k": 1}}])
    assert counts == {"added": 2, "skipped": 3}
    assert values(g.nodes, "label")["y"] is None and values(g.nodes, "k")["y"] == 1
    g, counts = E.add_edges(g, [{"source": "x", "target": "y", "weight": 2}, {"source": "x", "target": "y"}, {"source": "x", "target": "zz"}, {"source": "a", "target": "b"}, {"source": "y", "target": "x"}])
    assert counts == {"added": 2, "skipped": 3}
    with pytest.raises(E.GraphError):
        E.add_edge(g, "x", "y")
    with pytest.raises(E.GraphError):
        E.add_node(g, "x")
    assert E.remove_node(g, "b")[1] == {"edges_removed": 2}
    assert E.bulk_remove_nodes(g, ["a", "a", "q"])[1] == {"removed": 1, "not_found": 2}
    assert E.remove_edge(g, "x", "y").edges.where("source = 'x'").count() == 0
    assert E.update_edge(g, "x", "y", weight=9.0).edges.where("weight = 9").count() == 1
    g, counts = E.set_attributes(g, [{"id": "a", "attributes": {"k": "12.9"}}, {"id": "b", "attributes": {"k": "no"}}, {"id": "zz", "attributes": {}}])
    assert counts == {"set": 2, "not_found": 1} and values(g.nodes, "k")["a"] == 12 and values(g.nodes, "k")["b"] is None
    g = E.set_edge_attributes(g, "x", "y", {"kind": "z", "ok": True})
    assert g.edges.where("kind = 'z' AND ok").count() == 1
    assert E.add_column(g, "big", "Long").nodes.schema["big"].dataType.simpleString() == "bigint"
    assert E.clear(g)[1] == {"nodes_removed": 6, "edges_removed": 5}
    assert g.undo() is not g


def test_filters(spark):
    g = graph(spark, "split")
    assert set(values(FI.remove_isolates(g).nodes, "id")) == set("abcde")
    assert set(values(FI.filter_by_degree(g, 1, 1).nodes, "id")) == set("acde")
    assert set(values(FI.ego_network(g, "a", 1).nodes, "id")) == {"a", "b"}
    assert set(values(FI.ego_network(g, "a", 0).nodes, "id")) == {"a"}
    assert set(values(FI.ego_network(g, "c", 9).nodes, "id")) == set("abc")
    assert FI.giant_component(g)[1] == {"kept_nodes": 3, "removed_nodes": 3, "component_count": 3}
    with pytest.raises(FI_ERROR):
        FI.ego_network(g, "nobody")


FI_ERROR = E.GraphError


def test_appearance(spark):
    g = graph(spark, "path4")
    g = g.with_(nodes=g.nodes.withColumn("v", F.when(F.col("id") == "a", -5.0).when(F.col("id") == "b", -1.0).when(F.col("id") == "c", float("nan"))).withColumn("p", F.when(F.col("id") != "d", F.col("id"))))
    sizes = values(A.size_by_ranking(g, "v").nodes, "size")
    assert (sizes["a"], sizes["b"], sizes["c"], sizes["d"]) == (5.0, 50.0, 5.0, 10.0)
    assert values(A.color_by_ranking(g, "v").nodes, "g") == {"a": 255, "b": 0, "c": 255, "d": 153}
    with pytest.raises(E.GraphError):
        A.size_by_ranking(g, "label")
    painted, info = A.color_by_partition(g, "p")
    assert info == {"partitions": 3} and [values(painted.nodes, "r")[k] for k in "abcd"] == [31, 255, 44, 153]
    assert values(A.reset_appearance(painted).nodes, "r") == dict.fromkeys("abcd", 153)
    with pytest.raises(E.GraphError):
        A.set_node_color(g, "a", 256, 0, 0)


def test_order_and_pages(spark):
    numbered = with_seq(spark.range(1000).select((999 - F.col("id")).alias("k")), "k").collect()
    assert sorted((r.seq, r.k) for r in numbered) == [(i, i) for i in range(1000)]
    g = from_edges(spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string"))
    assert [r.id for r in Q.query_nodes(g, 2, 1).collect()] == ["b", "c"]
    assert Q.query_nodes(g, 0).count() == 0 and Q.query_nodes(g, 10, 99).count() == 0 and Q.query_nodes(g, 10, -5).count() == 3
    assert [r.id for r in Q.query_nodes(g, 10, where={"id": "c"}).collect()] == ["c"]
