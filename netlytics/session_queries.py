"""Queries that call operators by name in a session, over graphs of the test tables, with SQL that gives the same rows."""

from __future__ import annotations

import os
import re
import struct
import tempfile
import time
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import copurchase, membership, trade
from .graph import Graph, shared_path
from .operators import layout as L
from .operators import query as Q
from .operators import statistics as S
from .operators.components import component_labels
from .plans import jobs as J
from .plans import reports as R
from .queries import _copurchase, _trade, query
from .session import Session

_EDGES = _trade("", "SELECT s AS source, t AS target, w AS weight FROM e")
_NODES = _trade("", "SELECT id, label, r_name FROM n")


def _session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    _do(s, "create_project", name="trade")
    s.graph = trade(spark, sf_dir).checkpoint()
    return s


def _do(s: Session, operator: str, **parameters) -> dict:
    """The answer of an operator that must succeed."""
    out = s.call(operator, **parameters)
    if not out.pop("success"):
        raise RuntimeError(f"{operator}: {out['error']}")
    return out


def _after(spark: SparkSession, sf_dir: str, operator: str, **parameters) -> Graph:
    s = _session(spark, sf_dir)
    _do(s, operator, **parameters)
    return s.graph


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- files


def _back(spark: SparkSession, sf_dir: str, write: str, read: str, ending: str, before=lambda s: None, **options) -> Graph:
    """The trade graph written to a file and imported into a new project."""
    s = _session(spark, sf_dir)
    before(s)
    path = f"{shared_path(spark)}.{ending}"
    _do(s, write, file=path, **options)
    new = Session(spark)
    _do(new, "create_project")
    _do(new, read, file=path)
    return new.graph


def _odd_label(s: Session) -> None:
    _do(s, "set_node_label", id="N0", label='x, "y" & <z>')


_ODD = _trade("", """SELECT id, CASE id WHEN 'N0' THEN 'x, "y" & <z>' ELSE label END AS label, r_name FROM n""")


@query(_ODD)
def import_csv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "export_csv", "import_csv", "csv", _odd_label, target="nodes").nodes.select("id", "label", "r_name")


@query(_EDGES)
def import_csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "export_csv", "import_csv", "csv", target="edges").edges.select("source", "target", "weight")


@query(_ODD)
def import_gexf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "export_gexf", "import_gexf", "gexf", _odd_label).nodes.select("id", "label", "r_name")


@query(_EDGES)
def import_gexf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "export_gexf", "import_file", "gexf").edges.select("source", "target", "weight")


@query(_ODD)
def import_graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "export_graphml", "import_graphml", "graphml", _odd_label).nodes.select("id", "label", "r_name")


@query(_EDGES)
def import_graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, sf_dir, "export_graphml", "import_file", "graphml").edges.select("source", "target", "weight")


def _imported(spark: SparkSession, sf_dir: str, ending: str, head: str, node, middle: str, edge, tail: str, keep: str = "true") -> Graph:
    """A text file of the trade graph (of the edges to keep), imported by its ending."""
    g = trade(spark, sf_dir)
    path = f"{shared_path(spark)}.{ending}"
    fixed = _rows(spark, [(0, 0, head), (2, 0, middle), (4, 0, tail)], "block int, seq long, line string").where("line <> ''")
    lines = fixed.unionByName(g.nodes.select(F.lit(1).alias("block"), "seq", node.alias("line"))).unionByName(g.edges.where(keep).select(F.lit(3).alias("block"), "seq", edge.alias("line")))
    lines.orderBy("block", "seq").coalesce(1).sortWithinPartitions("block", "seq").select("line").write.text(path)
    s = Session(spark)
    _do(s, "import_file", file=path)
    return s.graph


_OFTEN = "SELECT s AS source, t AS target, {} AS directed, {} AS weight FROM e"


def _gexf(spark: SparkSession, sf_dir: str, default: str, keep: str = "true") -> Graph:
    """The trade graph as GEXF: edges of weight over 100 say their type, the others have the graph's; nodes of one region leave their region to the attribute's default."""
    head = f'''<gexf xmlns="http://gexf.net/1.3">
<graph mode="static"
  {default}>
<attributes class="node"><attribute id="0" title="r_name" type="string"><default>ASIA</default></attribute><attribute id="1" title="rank" type="integer"><default>7</default></attribute></attributes><nodes>'''
    value = F.when(F.col("r_name") != "ASIA", F.concat(F.lit('<attvalues><attvalue for="0" value="'), "r_name", F.lit('"/></attvalues>'))).otherwise("")
    node = F.concat(F.lit('<node id="'), "id", F.lit('">'), value, F.lit("</node>"))
    kind = F.when(F.col("weight") > 100, F.lit(' type="undirected"')).otherwise("")
    edge = F.concat(F.lit('<edge source="'), "source", F.lit('" target="'), "target", F.lit('"'), kind, F.lit(' weight="'), F.col("weight").cast("string"), F.lit('"/>'))
    return _imported(spark, sf_dir, "gexf", head, node, "</nodes><edges>", edge, "</edges></graph></gexf>", keep)


@query(_trade("", _OFTEN.format("FALSE", "w")))
def import_gexf_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gexf(spark, sf_dir, 'defaultedgetype="undirected"').edges.select("source", "target", "directed", "weight")


@query(_trade("", _OFTEN.format("w <= 100", "w") + " WHERE s <= t UNION ALL SELECT t, s, TRUE, w FROM e WHERE w <= 100 AND s < t"))
def import_gexf_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gexf(spark, sf_dir, "defaultedgetype='mutual'", keep="source <= target").edges.select("source", "target", "directed", "weight")


@query(_trade("", "SELECT id, id AS label, r_name, 7 AS rank, CAST(10 AS FLOAT) AS size, 153 AS r, TRUE AS placed FROM n"))
def import_gexf_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gexf(spark, sf_dir, "").nodes.select("id", "label", "r_name", "rank", "size", "r", F.col("x").between(-500, 500).alias("placed"))


def _graphml(spark: SparkSession, sf_dir: str, default: str) -> Graph:
    """The trade graph as GraphML: edges of weight over 100 have a weight and a direction of their own, the others those of the key and the graph."""
    head = f'''<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="edge" attr.name="weight" attr.type="double"><default>7.5</default></key>
<key id="d1" for="all" attr.name="r_name" attr.type="string"><default>ASIA</default></key><graph id="G" {default}>'''
    value = F.when(F.col("r_name") != "ASIA", F.concat(F.lit('<data key="d1">'), "r_name", F.lit("</data>"))).otherwise("")
    node = F.concat(F.lit('<node id="'), "id", F.lit('">'), value, F.lit("</node>"))
    often = F.col("weight") > 100
    edge = F.concat(F.lit('<edge source="'), "source", F.lit('" target="'), "target", F.when(often, F.lit('" directed="true"><data key="d0">')).otherwise(F.lit('">')), F.when(often, F.concat(F.col("weight").cast("string"), F.lit("</data>"))).otherwise(""), F.lit("</edge>"))
    return _imported(spark, sf_dir, "graphml", head, node, "", edge, "</graph></graphml>")


@query(_trade("", _OFTEN.format("w > 100", "CASE WHEN w > 100 THEN w ELSE 7.5 END")))
def import_graphml_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphml(spark, sf_dir, 'edgedefault="undirected"').edges.select("source", "target", "directed", "weight")


@query(_trade("", "SELECT id, id AS label, r_name, CAST(10 AS FLOAT) AS size, TRUE AS placed FROM n"))
def import_graphml_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphml(spark, sf_dir, "edgedefault='directed'").nodes.select("id", "label", "r_name", "size", F.col("x").between(-500, 500).alias("placed"))


def _gml(spark: SparkSession, sf_dir: str) -> Graph:
    node = F.format_string('node [ id "%s" graphics [ x %s y 2 fill "#0a141e" ] label "%s ] of" r_name "%s" ]', "id", F.col("seq").cast("string"), "label", "r_name")
    return _imported(spark, sf_dir, "gml", "graph [ directed 1", node, "", F.format_string('edge [ source "%s" target "%s" value %s ]', "source", "target", F.col("weight").cast("string")), "]")


@query(_trade("", "SELECT id, label || ' ] of' AS label, r_name, CAST(seq AS FLOAT) AS x, 10 AS r FROM n"))
def import_gml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gml(spark, sf_dir).nodes.select("id", "label", "r_name", "x", "r")


@query(_EDGES)
def import_gml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gml(spark, sf_dir).edges.select("source", "target", "weight")


def _dot(spark: SparkSession, sf_dir: str) -> Graph:
    node = F.format_string('"%s" [label="%s", r_name="%s"]; /* a remark; */', "id", "label", "r_name")
    return _imported(spark, sf_dir, "dot", "digraph { edge [kind=trade]; ", node, "", F.format_string("%s -> %s [weight=%s];", "source", "target", F.col("weight").cast("string")), "}")


@query(_NODES)
def import_dot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dot(spark, sf_dir).nodes.select("id", "label", "r_name")


@query(_trade("", "SELECT s AS source, t AS target, w AS weight, 'trade' AS kind FROM e"))
def import_dot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dot(spark, sf_dir).edges.select("source", "target", "weight", "kind")


def _pajek(spark: SparkSession, sf_dir: str) -> Graph:
    number = lambda c: (F.substring(c, 2, 9).cast("int") + 1).cast("string")
    node = F.format_string('%s "%s" 0.5 0.25', number("id"), "label")
    return _imported(spark, sf_dir, "net", "*Vertices 26", node, "*Arcs", F.format_string("%s %s %s", number("source"), number("target"), F.col("weight").cast("string")), "")


@query(_trade("", "SELECT CAST(seq + 1 AS VARCHAR) AS id, label, CAST(0.5 AS FLOAT) AS x FROM n UNION ALL SELECT '26', '26', NULL"))
def import_pajek_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pajek(spark, sf_dir).nodes.select("id", "label", F.when(F.col("id") != "26", F.col("x")).alias("x"))


@query(_trade("", "SELECT CAST(CAST(s[2:] AS INT) + 1 AS VARCHAR) AS source, CAST(CAST(t[2:] AS INT) + 1 AS VARCHAR) AS target, w AS weight FROM e"))
def import_pajek_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pajek(spark, sf_dir).edges.select("source", "target", "weight")


@query(_trade("", "SELECT 'circle' AS shape, count(*) AS n FROM n UNION ALL SELECT 'path', count(*) FROM e UNION ALL SELECT 'polygon', count(*) FROM e UNION ALL SELECT 'text', count(*) FROM n UNION ALL SELECT 'Q', count(*) FROM e UNION ALL SELECT 'Courier New', count(*) FROM n UNION ALL SELECT '#123456', count(*) FROM n UNION ALL SELECT 'rect', count(*) + 1 FROM n"))
def export_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, "set_preview_settings", **{"node.label.show": True, "edge.curved": True, "node.label.font": "Courier New 9 Bold", "node.border.color": "#123456", "node.label.box": True, "arrow.size": 2})
    path = f"{shared_path(spark)}.svg"
    _do(s, "export_svg", file=path)
    shapes = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?:<(?=(?:circle|path|polygon|text|rect) )|(?= Q )|(?=Courier New|#123456)) ?([a-zQ]+|Courier New|#123456)"), F.lit(1))).alias("shape"))
    return shapes.groupBy("shape").agg(F.count("*").alias("n"))


def _file(s: Session, operator: str, **options) -> bytes:
    with tempfile.TemporaryDirectory() as folder:  # pictures are files of the driver
        file = os.path.join(folder, "picture")
        _do(s, operator, file=file, **options)
        with open(file, "rb") as f:
            return f.read()


@query("SELECT 'PNG' AS kind, 320 AS width, 200 AS height, TRUE AS whole, TRUE AS has_nodes")
def export_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, "batch_set_node_colors", nodes=[{"id": f"N{i}", "r": 200, "g": 10, "b": 30} for i in range(25)])
    raw = _file(s, "export_png", width=320, height=200)
    width, height = struct.unpack(">2I", raw[16:24])
    at = raw.index(b"IDAT")
    pixels = zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]])
    return _rows(spark, [(raw[1:4].decode(), width, height, len(pixels) == height * (1 + 3 * width), bytes((200, 10, 30)) in pixels)], "kind string, width int, height int, whole boolean, has_nodes boolean")


@query(_trade("", "SELECT 'PDF-1.4' AS kind, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges"))
def export_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, "set_preview_settings", **{"edge.curved": False})
    raw = _file(s, "export_pdf")
    body = zlib.decompress(re.search(rb"stream\n(.*?)\nendstream", raw, re.S)[1]).decode()
    return _rows(spark, [(raw[1:8].decode(), len(re.findall(r" c [fB]$", body, re.M)), len(re.findall(r" l S$", body, re.M)))], "kind string, nodes long, edges long")


@query(_trade("", "SELECT id, label, r_name, 2 AS workspaces, 'trade' AS project FROM n"))
def open_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, "new_workspace")
    _do(s, "switch_workspace", index=0)
    path = shared_path(spark)
    _do(s, "save_project", file=path)
    new = Session(spark)
    n = _do(new, "open_project", file=path)["workspaces"]
    return new.graph.nodes.select("id", "label", "r_name", F.lit(n).alias("workspaces"), F.lit(new.name).alias("project"))


# ---------------------------------------------------------------- sessions


@query("SELECT 'running' AS status")
def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(_do(_session(spark, sf_dir), "health_check")["status"],)], "status string")


@query(_trade("", "SELECT TRUE AS has_project, 'trade' AS name, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count, TRUE AS is_directed, FALSE AS is_mixed"))
def project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["has_project", "name", "node_count", "edge_count", "is_directed", "is_mixed"]
    info = _do(_session(spark, sf_dir), "get_project_info")
    return _rows(spark, [tuple(info[n] for n in names)], "has_project boolean, name string, node_count long, edge_count long, is_directed boolean, is_mixed boolean")


@query("SELECT FALSE AS is_directed, FALSE AS is_undirected, TRUE AS is_mixed")
def graph_type_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, "add_node", id="new")
    _do(s, "add_edge", source="new", target="N0", directed=False)
    return Q.graph_type(s.graph)


@query(_trade("", """SELECT * FROM (SELECT count(*) AS nodes FROM n), (VALUES (1, 'create_project', 1, 1), (2, 'new_workspace', 2, 2), (3, 'new_workspace', 3, 3), (4, 'switch_workspace', 3, 1),
(5, 'delete_workspace', 2, 1), (6, 'delete_workspace', 1, 1)) t(step, operator, workspaces, current) WHERE TRUE"""))
def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step with the number of workspaces and the current one's id; the first keeps its nodes."""
    s = _session(spark, sf_dir)
    nodes = s.graph.nodes.count()
    rows = []

    def note(operator: str) -> None:
        found = _do(s, "list_workspaces")["workspaces"]
        rows.append((nodes if s.workspaces[0][1].nodes.count() == nodes else -1, len(rows) + 1, operator, len(found), next(w["id"] for w in found if w["current"])))

    note("create_project")
    for operator, options in (("new_workspace", {}), ("new_workspace", {}), ("switch_workspace", {"index": 0}), ("delete_workspace", {"index": 1}), ("delete_workspace", {"index": 1})):
        _do(s, operator, **options)
        note(operator)
    return _rows(spark, rows, "nodes long, step int, operator string, workspaces int, current int")


@query("""SELECT * FROM (VALUES ('add_node', FALSE), ('add_edge', FALSE), ('remove_edge', FALSE), ('set_node_position', FALSE), ('import_file', FALSE), ('color_by_ranking', FALSE),
('remove_node', FALSE), ('run_layout', FALSE), ('nothing_of_the_kind', FALSE), ('get_graph_stats', TRUE)) t(operator, success)""")
def error_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever goes wrong is an answer with an error."""
    s = _session(spark, sf_dir)
    calls = [
        ("add_node", {}), ("add_edge", {"source": "N0", "target": "nowhere"}), ("remove_edge", {"source": "N0", "target": "zz"}), ("set_node_position", {"id": "N0", "x": "abc"}), ("import_file", {"file": "/no/such/file.gml"}),
        ("color_by_ranking", {"column": "r_name"}), ("remove_node", {"id": "zz"}), ("run_layout", {"algorithm": "none such"}), ("nothing_of_the_kind", {}), ("get_graph_stats", {}),
    ]
    rows = [(name, out["success"]) for name, k in calls if (out := s.call(name, **k))["success"] or out["error"]]
    return _rows(spark, rows, "operator string, success boolean")


# ---------------------------------------------------------------- elements


@query(_trade("", "SELECT id, label, CAST(NULL AS BIGINT) AS score FROM n UNION ALL SELECT 'new', 'New one', 7"))
def add_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "add_node", id="new", label="New one", attributes={"score": 7}).nodes.select("id", "label", F.col("score").cast("long").alias("score"))


@query(_trade("", "SELECT s AS source, t AS target FROM e WHERE s <> 'N3' AND t <> 'N3'"))
def remove_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "remove_node", id="N3").edges.select("source", "target")


@query(_trade("", "SELECT id, CASE id WHEN 'N4' THEN 'Fourth' ELSE label END AS label FROM n"))
def set_node_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "set_node_label", id="N4", label="Fourth").nodes.select("id", "label")


@query(_trade("", "SELECT id, CASE id WHEN 'N4' THEN 1.5 END AS x, CASE id WHEN 'N4' THEN -2.25 END AS y FROM n"))
def set_node_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _after(spark, sf_dir, "set_node_position", id="N4", x=1.5, y=-2.25)
    return g.nodes.select("id", *[F.when(F.col("id") == "N4", F.col(c).cast("double")).alias(c) for c in ("x", "y")])


@query(_trade("", "SELECT s AS source, t AS target, w AS weight, TRUE AS directed FROM e UNION ALL SELECT 'new', 'N1', 2.5, FALSE"))
def add_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, "add_node", id="new")
    _do(s, "add_edge", source="new", target="N1", weight=2.5, directed=False)
    return s.graph.edges.select("source", "target", "weight", "directed")


def _first_edge(s: Session) -> dict:
    e = s.graph.edges.orderBy("seq").first()
    return {"source": e["source"], "target": e["target"]}


def _edge_changed(spark: SparkSession, sf_dir: str, operator: str, **options) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, operator, **_first_edge(s), **options)
    return s.graph.edges


@query(_trade("", "SELECT s AS source, t AS target FROM e WHERE seq > (SELECT min(seq) FROM e)"))
def remove_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_changed(spark, sf_dir, "remove_edge").select("source", "target")


@query(_trade("", "SELECT s AS source, t AS target, CASE WHEN seq = (SELECT min(seq) FROM e) THEN 0.125 ELSE w END AS weight FROM e"))
def set_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_changed(spark, sf_dir, "set_edge_weight", weight=0.125).select("source", "target", "weight")


@query(_trade("", "SELECT s AS source, t AS target, CASE WHEN seq = (SELECT min(seq) FROM e) THEN 'first' END AS label FROM e"))
def set_edge_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_changed(spark, sf_dir, "set_edge_label", label="first").select("source", "target", "label")


@query(_trade("", "SELECT s AS source, t AS target, CASE WHEN seq = (SELECT min(seq) FROM e) THEN 3 END AS lanes, CASE WHEN seq = (SELECT min(seq) FROM e) THEN 'sea' END AS kind FROM e"))
def set_edge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_changed(spark, sf_dir, "set_edge_attributes", attributes={"lanes": 3, "kind": "sea"}).select("source", "target", F.col("lanes").cast("int").alias("lanes"), "kind")


@query(_trade("", "SELECT s AS source, t AS target, CASE WHEN seq = (SELECT min(seq) FROM e) THEN 9 ELSE 153 END AS r FROM e"))
def set_edge_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_changed(spark, sf_dir, "set_edge_color", r=9, g=8, b=7).select("source", "target", "r")


@query(_trade("", "SELECT (SELECT count(*) FROM n) AS nodes_removed, (SELECT count(*) FROM e) AS edges_removed, CAST(0 AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS edges"))
def clear_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    out = _do(s, "clear_graph")
    return _rows(spark, [(out["nodes_removed"], out["edges_removed"], s.graph.nodes.count(), s.graph.edges.count())], "nodes_removed long, edges_removed long, nodes long, edges long")


@query("SELECT * FROM (VALUES ('rank', 'Integer'), ('share', 'Double'), ('seen', 'Boolean'), ('note', 'String')) t(id, type)")
def add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    for name, kind in (("rank", "integer"), ("share", "double"), ("seen", "boolean"), ("note", "string")):
        _do(s, "add_column", name=name, type=kind)
    found = [(c["id"], c["type"]) for c in _do(s, "get_columns")["columns"] if not c["property"] and c["id"] != "r_name"]
    return _rows(spark, found, "id string, type string")


@query(_trade("", "SELECT id, CASE id WHEN 'N7' THEN 2.5 END AS share, CASE id WHEN 'N7' THEN 'far' ELSE r_name END AS r_name FROM n"))
def set_node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "set_node_attributes", id="N7", attributes={"share": 2.5, "r_name": "far"}).nodes.select("id", F.col("share").cast("double").alias("share"), "r_name")


# ---------------------------------------------------------------- filters and looks


@query(_EDGES)
def reset_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter, the reset (which changes nothing by itself), and ``undo``, which brings the edges back."""
    s = _session(spark, sf_dir)
    _do(s, "filter_by_edge_weight", min=1e9)
    _do(s, "reset_filters")
    if s.graph.edges.isEmpty():
        s.undo()
    return s.graph.edges.select("source", "target", "weight")


@query(_trade("", "SELECT id, CASE id WHEN 'N2' THEN 1 ELSE 153 END AS r, CASE id WHEN 'N2' THEN 4 ELSE 255 END AS a FROM n"))
def set_node_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "set_node_color", id="N2", r=1, g=2, b=3, a=4).nodes.select("id", "r", "a")


@query(_trade("", "SELECT id, CASE id WHEN 'N2' THEN 42.5 ELSE 10.0 END::DOUBLE AS size FROM n"))
def set_node_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "set_node_size", id="N2", size=42.5).nodes.select("id", F.col("size").cast("double").alias("size"))


@query(_trade("", "SELECT id, 11 AS r, 12 AS g, 13 AS b, 255 AS a, 6.0::DOUBLE AS size FROM n"))
def reset_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    _do(s, "color_by_partition", column="r_name")
    _do(s, "reset_appearance", r=11, g=12, b=13, size=6)
    return s.graph.nodes.select("id", "r", "g", "b", "a", F.col("size").cast("double").alias("size"))


@query("SELECT * FROM (VALUES ('arrow.size', '4.5'), ('background-color', '#102030'), ('edge.color', 'mixed'), ('edge.opacity', '100.0'), ('node.label.font', 'Courier New 10 Bold'), ('node.label.show', 'true'), ('properties_set', '5')) t(name, value)")
def preview_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each kind, one bad value and one unknown name; then what is set."""
    s = _session(spark, sf_dir)
    given = {"arrow.size": "4.5", "background-color": "#102030", "edge.color": "mixed", "edge.opacity": "much", "node.label.font": "Courier New 10 Bold", "node.label.show": "true", "no.such.setting": 1}
    n = _do(s, "set_preview_settings", **given)["properties_set"]
    found = _do(s, "get_preview_settings")["settings"]
    rows = [(k, str(found[k]).lower() if isinstance(found[k], bool) else str(found[k])) for k in given if k in found]
    return _rows(spark, [*rows, ("properties_set", str(n))], "name string, value string")


# ---------------------------------------------------------------- layouts


@query("SELECT * FROM (VALUES ('Circular'), ('Random Layout'), ('Fruchterman Reingold'), ('ForceAtlas 2'), ('Yifan Hu'), ('Noverlap'), ('Label Adjust')) t(layout)")
def available_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(x,) for x in _do(_session(spark, sf_dir), "get_available_layouts")["layouts"]], "layout string")


@query("SELECT * FROM (VALUES ('scalingRatio', 2.0::DOUBLE), ('gravity', 1.0), ('edgeWeightInfluence', 1.0), ('jitterTolerance', 1.0), ('barnesHutTheta', 1.2)) t(name, value)")
def layout_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _do(_session(spark, sf_dir), "get_layout_properties", algorithm="forceatlas2")["properties"]
    return _rows(spark, [(p["name"], p["value"]) for p in found if p["type"] == "float"], "name string, value double").select("name", F.round("value", 6).alias("value"))


def _finished(s: Session) -> dict:
    while _do(s, "get_layout_status")["running"]:
        time.sleep(0.05)
    return _do(s, "get_layout_status")


@query(_trade("", "SELECT id, 70.0::DOUBLE AS radius, 'new' AS edited, 'Circular' AS layout FROM n"))
def set_layout_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout with a property of its own, run beside an edit; both count."""
    s = _session(spark, sf_dir)
    _do(s, "set_layout_properties", algorithm="circular", properties={"Radius": 70})
    _do(s, "add_column", name="edited", type="string")
    name = _finished(s)["layout"]
    g = s.graph
    edited = F.lit("new") if "edited" in g.nodes.columns else F.lit("lost")
    return g.nodes.select("id", F.round(F.sqrt(F.pow(F.col("x").cast("double"), 2) + F.pow(F.col("y").cast("double"), 2)), 3).alias("radius"), edited.alias("edited"), F.lit(name).alias("layout"))


@query("SELECT TRUE AS refused, TRUE AS stopped")
def stop_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second layout is refused while one runs; a stopped one ends long before its rounds are done."""
    s = _session(spark, sf_dir)
    _do(s, "run_layout", algorithm="ForceAtlas 2", iterations=100_000)
    refused = not s.call("run_layout", algorithm="Circular")["success"]
    _do(s, "stop_layout")
    return _rows(spark, [(refused, not _do(s, "get_layout_status")["running"])], "refused boolean, stopped boolean")


_STARS = "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, TRUE AS finite, TRUE AS linked_nearer"


def _by_forces(spark: SparkSession, sf_dir: str, algorithm: str, rounds: int, **properties) -> DataFrame:
    """Whether linked nodes end nearer to each other than all do, on average: nations around their regions."""
    g = L.run_layout(membership(spark, sf_dir), algorithm, rounds, properties)
    return _linked_nearer(g)


def _linked_nearer(g: Graph) -> DataFrame:
    """Root mean squares of the distances of links and of all pairs; the latter from sums of coordinates, without pairs."""
    at = g.nodes.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = g.edges.where("source <> target").select("source", "target").join(at.toDF("source", "sx", "sy"), "source").join(at.toDF("target", "tx", "ty"), "target")
    links = ends.agg(F.avg(F.pow(F.col("sx") - F.col("tx"), 2) + F.pow(F.col("sy") - F.col("ty"), 2)).alias("near"))
    n = F.col("nodes").cast("double")
    sums = at.agg(F.count("*").alias("nodes"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("most"), F.avg(F.pow("x", F.lit(2)) + F.pow("y", F.lit(2))).alias("squares"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    every = 2 * (F.col("squares") - F.col("mx") ** 2 - F.col("my") ** 2) * n / (n - 1)
    return sums.join(links).select("nodes", (F.col("most") < 1e6).alias("finite"), (F.col("near") < 0.49 * every).alias("linked_nearer"))


@query(_STARS)
def forceatlas2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_forces(spark, sf_dir, "ForceAtlas 2", 15, scalingRatio=10)


@query(_STARS)
def fruchterman_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_forces(spark, sf_dir, "Fruchterman Reingold", 15)


@query(_STARS)
def yifan_hu_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_forces(spark, sf_dir, "Yifan Hu", 20)


@query(_copurchase("", "SELECT count(*) AS nodes, TRUE AS finite, TRUE AS linked_nearer FROM n"))
def yifan_hu_copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the whole co-purchase graph, 12 rounds in all."""
    return _linked_nearer(L.run_layout(L.run_layout(copurchase(spark, sf_dir), "random"), "Yifan Hu", 12))


@query(_trade("", "SELECT count(*) AS nodes, TRUE AS inside, TRUE AS repeatable, count(*) AS places FROM n"))
def random_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade(spark, sf_dir)
    a, b = (L.run_layout(g, "random", properties={"size": 100}).nodes.select("id", "x", "y") for _ in range(2))
    half = (F.abs("x") <= 50) & (F.abs("y") <= 50)
    return a.select(F.lit(1).alias("k"), "*").groupBy("k").agg(F.count("*").alias("nodes"), F.bool_and(half).alias("inside"), F.lit(a.exceptAll(b).isEmpty()).alias("repeatable"), F.count_distinct("x", "y").alias("places")).drop("k")


def _overlaps(g: Graph, reach) -> int:
    a = g.nodes.select("id", "x", "y", reach.alias("w"))
    b = a.toDF("o", "ox", "oy", "ow")
    return a.join(b, F.col("id") < F.col("o")).where(F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)) < (F.col("w") + F.col("ow")) * 0.99).count()


def _apart(spark: SparkSession, sf_dir: str, algorithm: str, reach) -> DataFrame:
    """The 25 nations, closer together than they are wide, before and after."""
    g = L.run_layout(trade(spark, sf_dir), "random", properties={"size": 200}).checkpoint()
    after = L.run_layout(g, algorithm, 25)
    return _rows(spark, [(_overlaps(g, reach) > 0, _overlaps(after, reach))], "overlapped boolean, overlaps int")


@query("SELECT TRUE AS overlapped, 0 AS overlaps")
def noverlap_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apart(spark, sf_dir, "Noverlap", F.col("size") / 2)


@query("SELECT TRUE AS overlapped, 0 AS overlaps")
def label_adjust_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apart(spark, sf_dir, "Label Adjust", F.col("size") / 2)


# ---------------------------------------------------------------- workflows


def _stars(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    _do(s, "create_project", name="stars")
    s.graph = membership(spark, sf_dir).checkpoint()
    return s


@query("""WITH k AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), m AS (SELECT sum(c) AS m FROM k)
SELECT count(*) AS communities, CAST(sum(c + 1) AS BIGINT) AS nodes, round(1 - sum((2.0::DOUBLE * c) ^ 2) / (2.0 * max(m)) ^ 2, 9) AS modularity, TRUE AS palette, TRUE AS sizes, 'very strong' AS quality FROM k, m""")
def community_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations around their regions: Louvain finds the regions."""
    s = _stars(spark, sf_dir)
    found, sizes = J.community_detection(s, iterations=3)
    palette = {tuple(r) for r in s.graph.nodes.select("r", "g", "b").distinct().collect()} <= set(J.COMMUNITY_PALETTE)
    low, high = s.graph.nodes.agg(F.min("size"), F.max("size")).first()
    total = sizes.agg(F.sum("size")).first()[0]
    return _rows(spark, [(found["communities"], total, round(found["modularity"], 9), palette, low == 3 and high == 25, found["quality"])], "communities long, nodes long, modularity double, palette boolean, sizes boolean, quality string")


@query(_copurchase("", "SELECT (SELECT count(*) FROM n) AS nodes, TRUE AS numbered, TRUE AS better_than_brands, TRUE AS better_than_one, TRUE AS score_agrees, TRUE AS connected"))
def louvain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever communities are found: classes from 0 without a gap, a modularity above those of known partitions, and each connected within itself."""
    g, scalars = S.compute_modularity(copurchase(spark, sf_dir).checkpoint())
    g = g.checkpoint()
    classes = g.nodes.select("id", F.col("modularity_class").alias("community"))
    n, top, kinds = classes.agg(F.count("*"), F.max("community"), F.count_distinct("community")).first()
    score = lambda m: S.modularity_score(g, m).first()[0]
    found = score(classes)
    brands = score(g.nodes.select("id", F.col("p_brand").alias("community")))
    inside = g.edges.join(classes.toDF("source", "cs"), "source").join(classes.toDF("target", "ct"), "target").where("cs = ct")
    parts = component_labels(inside.select(F.col("source").alias("a"), F.col("target").alias("b"))).select("label").distinct().count()
    parts += classes.groupBy("community").count().where("count = 1").count()  # nodes by themselves
    row = (n, top + 1 == kinds == scalars["communities"], found > brands, found > 0, abs(found - scalars["modularity"]) < 1e-9, parts == kinds)
    return _rows(spark, [row], "nodes long, numbered boolean, better_than_brands boolean, better_than_one boolean, score_agrees boolean, connected boolean")


@query("""SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1 AS node_count, (SELECT count(*) FROM nation) AS edge_count, (SELECT count(*) FROM region) AS communities,
(SELECT count(*) FROM region) + 1 AS connected_components, TRUE AS is_directed, CAST(1 AS BIGINT) AS isolates_removed""")
def import_and_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GraphML file of the stars and one node without an edge."""
    s = _stars(spark, sf_dir)
    _do(s, "add_node", id="alone")
    path = f"{shared_path(spark)}.graphml"
    _do(s, "export_graphml", file=path)
    out = J.import_and_explore(Session(spark), path, iterations=2)
    names = ["node_count", "edge_count", "communities", "connected_components", "is_directed", "isolates_removed"]
    return _rows(spark, [(*(out[n] - (n == "communities") for n in names[:4]), out["is_directed"], out["isolates_removed"])], "node_count long, edge_count long, communities long, connected_components long, is_directed boolean, isolates_removed long")


_STAR_SQL = """WITH k AS (SELECT n_regionkey AS c, count(*) AS k FROM nation GROUP BY 1), z AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n),
v AS (SELECT 'R' || c AS id, k AS degree, 0 AS outdegree, k * (k - 1) / 2.0 / ((n - 1) * (n - 2) / 2.0) AS b FROM k, z UNION ALL SELECT 'N' || n_nationkey, 1, 1, 0.0 FROM nation)"""


@query(_STAR_SQL + " SELECT id, CAST(degree AS INT) AS degree, round(CAST(b AS DOUBLE), 9) AS betweenesscentrality, 0.0::DOUBLE AS clustering, TRUE AS whole FROM v")
def recommended_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight statistics; the values of stars are known in closed form."""
    s = _stars(spark, sf_dir)
    J.recommended_order(s, {"compute_pagerank": {"rounds": 5}, "compute_eigenvector": {"rounds": 5}, "compute_hits": {"rounds": 5}})
    whole = F.lit(True)
    for c in ("componentnumber", "modularity_class", "pageranks", "eigencentrality", "Authority", "Hub"):
        whole = whole & F.col(c).isNotNull()
    return s.graph.nodes.select("id", "degree", F.round("betweenesscentrality", 9).alias("betweenesscentrality"), "clustering", whole.alias("whole"))


@query("SELECT * FROM (VALUES ('clean', TRUE), ('labelled', TRUE), ('svg', TRUE)) t(picture, written)")
def visualise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stars(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:  # pictures are files of the driver
        out = J.visualise(s, os.path.join(folder, "net"), 640, 360)
        return _rows(spark, [(k, os.path.exists(v)) for k, v in out.items()], "picture string, written boolean")


@query(_STAR_SQL + """, q AS (SELECT quantile_cont(b, 0.5) AS qb, quantile_cont(degree, 0.5) AS qd FROM v)
SELECT id, CASE WHEN b > qb AND degree > qd THEN 'critical hub' WHEN b > qb THEN 'bridge' WHEN degree > qd THEN 'local hub' ELSE 'peripheral' END AS role FROM v, q""")
def roles_by_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = S.compute_degree(membership(spark, sf_dir))
    return R.roles(S.compute_betweenness(g)[0].nodes)


@query("""WITH k AS (SELECT n_regionkey AS c, count(*) AS k FROM nation GROUP BY 1)
SELECT 'R' || c AS community, k + 1 AS size, k AS internal_edges, round(2.0::DOUBLE * k / ((k + 1) * k), 9) AS internal_density, CAST(0 AS BIGINT) AS bridges, 'R' || c AS key_member FROM k""")
def community_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found communities, each named by its member of the greatest degree."""
    g = membership(spark, sf_dir).checkpoint()
    p = R.community_profile(g, S.louvain(g))
    return p.select(F.col("key_member").alias("community"), "size", "internal_edges", F.round("internal_density", 9).alias("internal_density"), "bridges", "key_member")


@query("""SELECT p_partkey, p_size / 50.0::DOUBLE AS score, CASE WHEN p_size < 15 THEN 'weak' WHEN p_size < 25 THEN 'moderate' WHEN p_size <= 35 THEN 'strong' ELSE 'very strong' END AS band FROM part""")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of parts, of 50, as scores."""
    scores = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") / 50.0).alias("score"))
    return scores.withColumn("band", R.quality_band(F.col("score")))


@query(_STAR_SQL + """, top AS (SELECT 'degree' AS metric, id, CAST(degree AS DOUBLE) AS value, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM v UNION ALL
SELECT 'betweenesscentrality', id, b, row_number() OVER (ORDER BY b DESC, id) FROM v UNION ALL
SELECT 'pageranks', id, (1 + 0.85::DOUBLE * (degree - outdegree)) / (n + 0.85 * (SELECT count(*) FROM nation)), row_number() OVER (ORDER BY degree - outdegree DESC, id) FROM v, z)
SELECT metric, CAST(rank AS INT) AS rank, round(CAST(value AS DOUBLE), 6) AS value FROM top WHERE rank <= 5""")
def structural_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top lists of the report; the values of stars are known in closed form, those of PageRank up to its tolerance."""
    _, top = R.structural_report(membership(spark, sf_dir).checkpoint())
    return top.select("metric", "rank", F.round("value", 6).alias("value"))


@query("""WITH k AS (SELECT n_regionkey AS r, CAST(count(*) AS DOUBLE) AS k FROM nation GROUP BY 1), z AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n, sum(k) AS e FROM k)
SELECT max(n) AS node_count, CAST(max(e) AS BIGINT) AS edge_count, round(2 * max(e / (n * (n - 1))), 9) AS density, round(2 * max(e / n), 9) AS average_degree, TRUE AS is_directed, 1 AS min_degree, CAST(max(k) AS INT) AS max_degree,
CAST(count(*) AS INT) AS connected_components, round(1 - sum((2 * k) ^ 2) / max(2 * e) ^ 2, 9) AS modularity, CAST(count(*) AS INT) AS communities, round(sum(k * k) / sum(k * (k + 1) / 2), 9) AS average_path_length, 2 AS diameter, 1 AS radius,
0.0::DOUBLE AS average_clustering_coefficient, 'very strong' AS community_quality FROM k, z""")
def structural_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's row: stars are components and communities, their leaves two steps apart."""
    row, _ = R.structural_report(membership(spark, sf_dir).checkpoint())
    return row.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


@query("SELECT 'R' || n_regionkey AS id, CAST(4 AS BIGINT) AS lists FROM nation GROUP BY n_regionkey ORDER BY count(*) DESC, n_regionkey LIMIT 5")
def centrality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes in at least two of the four lists of the top five: the regions with the most nations lead in all of them."""
    return R.centrality_report(membership(spark, sf_dir).checkpoint(), 5)[1]
