import pytest

from netlytics.functions.values import font
from netlytics.operators import layout as L
from netlytics.session import Session
from netlytics.sources import tables as IO
from netlytics.streaming.edges import stored_edges, upsert_edges, windowed_weights


@pytest.fixture
def session(spark):
    s = Session(spark)
    s.call("create_project", name="p")
    s.call("add_nodes", nodes=[{"id": k} for k in "abcd"])
    s.call("add_edges", edges=[{"source": a, "target": b, "weight": i + 1} for i, (a, b) in enumerate(("ab", "bc", "ca"))])
    s.call("batch_set_node_attributes", updates=[{"id": "a", "attributes": {"name": '<x> & "y"', "n": 3}}])
    return s


def test_envelope(spark):
    s = Session(spark)
    assert len(s.operators()) == 73
    assert s.call("get_graph_stats") == {"success": False, "error": "No project open"}
    assert s.call("no_such_thing")["success"] is False and s.call("get_project_info") == {"success": True, "has_project": False}
    assert s.call("health_check")["status"] == "running"


def test_workspaces_and_projects(session, tmp_path):
    assert session.call("new_workspace") == {"success": True, "workspace_id": 2}
    assert session.call("get_graph_stats")["node_count"] == 0
    assert session.call("switch_workspace", index=0)["success"] and not session.call("switch_workspace", index=5)["success"]
    path = str(tmp_path / "project")
    assert session.call("save_project", file=path)["success"]
    again = Session(session.spark)
    assert again.call("open_project", file=path)["workspaces"] == 2
    info = again.call("get_project_info")
    assert (info["name"], info["node_count"], info["edge_count"], info["is_directed"]) == ("p", 4, 3, True)
    assert session.call("delete_workspace", index=1)["deleted"] == 2 and not again.call("open_project", file=path + "x")["success"]


@pytest.mark.parametrize("kind", ["gexf", "graphml"])
def test_files_come_back(session, tmp_path, kind):
    path = str(tmp_path / f"g.{kind}")
    session.call("set_node_color", id="b", r=1, g=2, b=3)
    session.call("set_node_size", id="b", size=99)
    assert session.call(f"export_{kind}", file=path)["success"]
    again = Session(session.spark)
    assert again.call("import_file", file=path) == {"success": True, "node_count": 4, "edge_count": 3}
    rows = {r["id"]: r for r in again.call("query_nodes")["nodes"]}
    assert (rows["b"]["r"], rows["b"]["size"]) == (1, 30.0) and rows["a"]["attributes"] == '{"name":"<x> & \\"y\\"","n":3}'
    assert sorted(e["weight"] for e in again.call("query_edges")["edges"]) == [1, 2, 3]


def test_csv_and_pictures(session, tmp_path):
    for target in ("nodes", "edges", "both"):
        session.call("export_csv", file=str(tmp_path / target), target=target)
        IO.merge(str(tmp_path / target), str(tmp_path / f"{target}.csv"))
    assert (tmp_path / "edges.csv").read_text() == "Source,Target,Weight\na,b,1.0\nb,c,2.0\nc,a,3.0\n"
    both = (tmp_path / "both.csv").read_text().split("\n")
    assert both[0] == "Id,Label,name,n" and both[5] == "" and both[6] == "Source,Target,Weight"
    assert session.call("import_csv", file=str(tmp_path / "edges"))["edge_count"] == 3
    for kind, head in (("svg", b"<?xml"), ("png", b"\x89PNG"), ("pdf", b"%PDF")):
        path = tmp_path / f"p.{kind}"
        assert session.call(f"export_{kind}", file=str(path))["success"]
        if kind == "svg":
            IO.merge(str(path), str(tmp_path / "one.svg"))
            text = (tmp_path / "one.svg").read_text()
            assert text.index("<path") < text.index("<circle") and text.count("<circle") == 4 and text.rstrip().endswith("</svg>")
        else:
            assert path.read_bytes().startswith(head)


def test_line_formats(spark, tmp_path):
    (tmp_path / "a.gml").write_text('graph [\n directed 1\n node [\n  id 1\n  label "one"\n ]\n node [ id 2 label "two" ]\n edge [ source 1 target 2 value 2.5 ]\n]\n')
    (tmp_path / "a.dot").write_text('digraph g {\n  node [shape=box];\n  a [label="A"];\n  a -> b -> "c d" [weight=2];\n}\n')
    (tmp_path / "a.net").write_text('*Vertices 3\n1 "one" 0.1 0.2\n2 "two"\n3 "three"\n*Arcs\n1 2 4\n*Edges\n2 3\n')
    g = IO.read_graph(spark, str(tmp_path / "a.gml"))
    assert {(r.id, r.label) for r in g.nodes.collect()} == {("1", "one"), ("2", "two")} and g.edges.first()["weight"] == 2.5
    g = IO.read_graph(spark, str(tmp_path / "a.dot"))
    assert {(r.source, r.target, r.weight) for r in g.edges.collect()} == {("a", "b", 2.0), ("b", "c d", 2.0)} and {r.id for r in g.nodes.collect()} == {"a", "b", "c d"}
    g = IO.read_graph(spark, str(tmp_path / "a.net"))
    assert {(r.source, r.target, r.weight, r.directed) for r in g.edges.collect()} == {("1", "2", 4.0, True), ("2", "3", 1.0, False)} and g.nodes.where("label = 'three'").count() == 1


def test_settings(session):
    assert font("Courier New 10 Bold") == {"name": "Courier New", "size": 10, "bold": True, "italic": False}
    out = session.call("set_preview_settings", **{"edge.color": "source", "node.label.font": "Courier New 10 Bold", "background-color": "#0a0B0c", "margin": "x", "zz": 1, "edge.curved": None})
    assert out == {"success": True, "properties_set": 3}
    settings = session.call("get_preview_settings")["settings"]
    assert (settings["background-color"], settings["edge.color"], settings["node.label.font"]) == ("#0a0b0c", "original", "Courier New 10 Bold")
    session.call("edge_thickness_by_weight", min_thickness=1, max_thickness=5)
    assert session.call("get_preview_settings")["settings"]["edge.rescale-weight"] is True


@pytest.mark.parametrize("name", ["Fruchterman Reingold", "forceatlas2", "yifan hu", "noverlap", "label adjust"])
def test_layouts(session, name):
    before = {r.id: (r.x, r.y) for r in session.graph.nodes.collect()}
    session.call("run_layout", algorithm=name, iterations=3)
    session.job.thread.join()
    assert session.call("get_layout_status") == {"success": True, "running": False, "layout": L.find_layout(name)}
    after = {r.id: (r.x, r.y) for r in session.graph.nodes.collect()}
    assert set(after) == set(before) and all(abs(v) < 1e6 for p in after.values() for v in p)


def test_overlap_goes(spark, session):
    session.call("batch_set_positions", positions=[{"id": k, "x": 0.0 if k < "c" else 50.0, "y": 0.0} for k in "abcd"])
    g = L.run_layout(session.graph.checkpoint(), "noverlap", 6)
    p = {r.id: (r.x, r.y) for r in g.nodes.collect()}
    assert abs(p["a"][0] - p["b"][0]) > 20 and abs(p["c"][0] - p["d"][0]) > 20
    assert not session.call("run_layout", algorithm="nothing")["success"]


def test_streams(spark, tmp_path):
    rows = [("a", "b", 1.0), ("a", "b", 2.0), (None, "b", 1.0), ("b", "c", 1.0)]
    spark.createDataFrame(rows, "source string, target string, weight double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, target string, weight double").parquet(str(tmp_path / "in"))
    upsert_edges(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in stored_edges(spark, str(tmp_path / "out")).collect()} == {("a", "b", 3.0), ("b", "c", 1.0)}
    timed = spark.sql("SELECT timestamp'2024-01-01 10:10:00' AS ts, 'a' AS source, 'b' AS target")
    timed.write.parquet(str(tmp_path / "timed"))
    live = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "timed"))
    windowed_weights(live).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").first()["weight"] == 1
