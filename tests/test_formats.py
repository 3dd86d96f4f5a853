"""Nested text formats, CSV quoting, and the tree of the layouts."""

import numpy as np
import pandas as pd
import pytest

from netlytics.graph import Graph, edge_frame, node_frame
from netlytics.operators import layout as L
from netlytics.session import Session
from netlytics.sources import tables as IO
from netlytics.sources.text_formats import ParseError, parse_dot, parse_gml, parse_pajek


def split(rows):
    rows = list(rows)
    return {r["id"]: r for r in rows if r["kind"] == "node"}, [(r["source"], r["target"], r["weight"], r["directed"]) for r in rows if r["kind"] == "edge"]


def test_dot_statements():
    nodes, edges = split(parse_dot('strict digraph "g" { a -> b; b -> c c [label="C; x"] /* d -> e */ subgraph s { d; e } -> f [weight=2.5]\n a:p:n -> {g h} // i\n node [shape=box]; "z\\"q"; x = 1 }'))
    assert set(nodes) == {"a", "b", "c", "d", "e", "f", "g", "h", 'z"q'} and nodes["c"]["label"] == "C; x" and nodes['z"q']["attributes"] == {"shape": "box"}
    assert edges == [("a", "b", 1, True), ("b", "c", 1, True), ("d", "f", 2.5, True), ("e", "f", 2.5, True), ("a", "g", 1, True), ("a", "h", 1, True)]
    assert split(parse_dot("graph { 1 -- 2 -- 3 [label=<<b>x</b>>] }"))[1] == [("1", "2", 1, False), ("2", "3", 1, False)]


def test_gml_nesting():
    nodes, edges = split(parse_gml('Creator "x"\ngraph [\n directed 1 # yes\n node [ id 1 graphics [ x 5 y 6 fill "#ff0010" w 3 ] label "a ] [ b" ]\n# node [\n node [ id 2 more [ deep [ er 4 ] ] ]\n edge [ source 1 target 2 value 2.5 ]\n]'.replace(" # yes", "")))
    assert (nodes["1"]["label"], nodes["1"]["x"], nodes["1"]["y"], nodes["1"]["r"], nodes["1"]["b"], nodes["1"]["size"]) == ("a ] [ b", 5, 6, 255, 16, 3)
    assert nodes["2"]["attributes"] == {"more.deep.er": "4"} and edges == [("1", "2", 2.5, True)]


def test_pajek_sections():
    nodes, edges = split(parse_pajek('*Network n\n*Vertices 3\n1 "one two" 0.1 0.2\n% remark\n*Arcs\n1 2 4\n*Edges\n2 3\n*Arcslist\n3 1 2\n*Matrix\n0 1.5 0\n0 0 0\n0 0 0\n'))
    assert set(nodes) == {"1", "2", "3"} and nodes["1"]["x"] == 0.1
    assert edges == [("1", "2", 4, True), ("2", "3", 1, False), ("3", "1", 1, True), ("3", "2", 1, True), ("1", "2", 1.5, True)]


@pytest.mark.parametrize(("parse", "text"), [
    (parse_dot, "digraph { a -- b }"), (parse_dot, "graph { a -- "), (parse_dot, 'graph { "a }'), (parse_dot, "nothing"), (parse_dot, "graph { a } b"),
    (parse_gml, "graph [ node [ id 1 "), (parse_gml, "graph [ node [ label 1 ] ]"), (parse_gml, "graph [ edge [ source 1 ] ]"), (parse_gml, 'graph [ a "'), (parse_gml, "]"),
    (parse_pajek, "1 2"), (parse_pajek, "*Arcs\n1"), (parse_pajek, "*Unknown\n1"), (parse_pajek, "*Matrix\nx"),
])
def test_nothing_is_passed_over(parse, text):
    with pytest.raises(ParseError):
        list(parse(text))


def test_files(spark, tmp_path):
    (tmp_path / "a.dot").write_text("digraph { a -> b [kind=x, n=2]; b -> c [n=3.5]; }")
    g = IO.read_graph(spark, str(tmp_path / "a.dot"))
    assert sorted((r.source, r.target, r.kind, r.n) for r in g.edges.collect()) == [("a", "b", "x", 2.0), ("b", "c", None, 3.5)]
    (tmp_path / "bad.dot").write_text("digraph { a -> ")
    s = Session(spark)
    out = s.call("import_file", file=str(tmp_path / "bad.dot"))
    assert not out["success"] and "line 1" in out["error"]


@pytest.mark.parametrize(
    ("ending", "text", "directed"),
    [
        ("gexf", '<gexf><graph {}><nodes><node id="a"/></nodes><edges><edge source="a" target="b"/><edge source="b" target="c" type="Directed"/><edge source="c" target="a" type="undirected" weight="2"/></edges></graph></gexf>', {'defaultedgetype="undirected"': False, "defaultedgetype = 'directed'": True, "": True}),
        ("graphml", '<graphml><!-- <graph edgedefault="undirected"> --><graph {}><node id="a"/><edge source="a" target="b"/><edge source="b" target="c" directed="true"/><edge source="c" target="a" directed="false"/></graph></graphml>', {'id="G"\n edgedefault="undirected"': False, 'edgedefault="directed"': True, "": True}),
    ],
)
def test_default_directions(spark, tmp_path, ending, text, directed):
    """Edges that do not say have the graph's direction, and are directed where it does not say either; nodes known from edges look like the others."""
    for i, (attribute, default) in enumerate(directed.items()):
        path = tmp_path / f"{i}.{ending}"
        path.write_text(text.format(attribute))
        g = IO.read_graph(spark, str(path))
        assert {(r["source"], r["target"]): (r["directed"], r["type"]) for r in g.edges.collect()} == {("a", "b"): (default, int(default)), ("b", "c"): (True, 1), ("c", "a"): (False, 0)}
        assert [(r["id"], r["label"], r["size"], r["r"], r["x"] is not None) for r in g.nodes.orderBy("id").collect()] == [(i, i, 10.0, 153, True) for i in "abc"]


def test_csv_keeps_any_text(spark, tmp_path):
    odd = ['x, "y"', "a\nb", " spaced ", "plain", "semi;colon", "'"]
    nodes = spark.createDataFrame([(str(i), i, t, t) for i, t in enumerate(odd)], "id string, seq long, label string, `note, more` string")
    g = Graph(node_frame(nodes), edge_frame(spark.createDataFrame([], "seq long, source string, target string")))
    IO.write_csv(g, str(tmp_path / "n.csv"))
    back = IO.read_csv(spark, str(tmp_path / "n.csv")).nodes
    assert sorted((r.id, r.label, r["note, more"]) for r in back.collect()) == sorted((str(i), t, t) for i, t in enumerate(odd))


def test_tree_against_the_exact_sum():
    r = np.random.RandomState(1)
    n = 2500
    x, y, m = r.randn(n) * 80, r.randn(n) * 60, r.randint(1, 9, n).astype(float)
    pdf = pd.DataFrame({"x": x, "y": y, "mass": m, "size": 10.0})
    force = lambda d, a, b: 2 * a * b / d
    exact = next(L._push([np.column_stack((np.zeros((n, 2)), m, x, y, np.full(n, 10.0), np.ones(n)))], 0.0, 1.2, force, False)(iter([pdf])))
    side, width = 1 << 12, max(np.ptp(x), np.ptp(y))
    keys, at = np.unique(np.stack((np.minimum((x - x.min()) / width * side // 1, side - 1), np.minimum((y - y.min()) / width * side // 1, side - 1)), 1), axis=0, return_inverse=True)
    at = at.ravel()
    mass = np.bincount(at, m)
    levels = L.levels_above(np.column_stack((keys, mass, np.bincount(at, m * x) / mass, np.bincount(at, m * y) / mass, np.full(len(mass), 10.0), np.bincount(at))))
    errors = []
    for theta in (0.3, 1.2):
        out = next(L._push(levels, width, theta, force, False)(iter([pdf])))
        errors.append(np.median(np.hypot(out.px - exact.px, out.py - exact.py) / np.hypot(exact.px, exact.py)))
    assert errors[0] < errors[1] < 0.05 and errors[0] < 0.005
