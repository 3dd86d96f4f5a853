"""Graph files in and out: CSV, GEXF, GraphML, GML, DOT, Pajek, and whole projects as Parquet.

Nested text formats are parsed in ``text_formats``.  Writers make folders of part files whose lines are in order when read part by part; ``merge`` joins them
into one file on the driver's file system, line by line, for programs that want a single file.
"""

from __future__ import annotations

import glob
import json
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGE_BUILTIN, NODE_BUILTIN, Graph, GraphError, edge_defaults, edge_frame, node_defaults, node_frame, start_position, with_seq
from ..operators.edit import add_edges_frame, add_nodes_frame
from .text_formats import parsed, with_attributes

_ATTRIBUTE_TYPES = {"string": "string", "int": "integer", "bigint": "long", "float": "float", "double": "double", "boolean": "boolean"}
_BACK = {"integer": "int", "int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "string": "string"}


def _typed(df: DataFrame, column: str, kind: str):
    return F.col(column).try_cast(_BACK.get(kind, "string"))


# ---------------------------------------------------------------- CSV


def read_csv(spark: SparkSession, path: str, separator: str = ",", multiline: bool = True) -> Graph:
    """Rows with Source and Target are edges, rows with Id are nodes; other columns become attributes with inferred types.

    Quoted fields may hold separators, quotation marks and line breaks.  Where no field holds a line break,
    ``multiline=False`` lets several tasks read one file.
    """
    df = spark.read.csv(path, header=True, sep=separator, inferSchema=True, escape='"', multiLine=multiline)
    names = {c.lower(): c for c in df.columns}
    if "source" in names and "target" in names:
        ren = {names[k]: k for k in ("source", "target", "weight", "label") if k in names}
        df = df.withColumnsRenamed(ren).withColumns({"source": F.col("source").cast("string"), "target": F.col("target").cast("string")})
        if "weight" in df.columns:
            df = df.withColumn("weight", F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)))
        if "type" in names:
            df = df.withColumn("directed", ~(F.lower(F.col(names["type"]).cast("string")) == "undirected")).drop(names["type"])
        df = df.drop(*[names[k] for k in ("id", "seq") if k in names])
        return from_tables(None, with_seq(df, "source", "target"))
    if "id" in names:
        ren = {names[k]: k for k in ("id", "label") if k in names}
        df = df.withColumnsRenamed(ren).withColumn("id", F.col("id").cast("string"))
        return from_tables(with_seq(df.dropDuplicates(["id"]), "id"), None)
    raise GraphError("a CSV file needs the columns Source and Target, or Id")


def from_tables(nodes: DataFrame | None, edges: DataFrame | None) -> Graph:
    """A graph of imported rows: ends that no row declares become nodes, and what a node or edge does not say has its default, whatever the format."""
    spark = (nodes if nodes is not None else edges).sparkSession
    if edges is None:
        edges = spark.createDataFrame([], "seq long, source string, target string")
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).where("id IS NOT NULL").distinct()
    if nodes is None:
        nodes = with_seq(ends, "id")
    else:
        more = ends.join(nodes.select("id"), "id", "left_anti")
        start = (nodes.agg(F.max("seq")).first()[0] or 0) + 1
        nodes = nodes.unionByName(with_seq(more, "id").withColumn("seq", F.col("seq") + start), allowMissingColumns=True)
    return Graph(_filled(node_frame(nodes), node_defaults()), _filled(edge_frame(edges), edge_defaults()))


def _filled(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, v) for c, v in defaults.items() if c in df.columns})


def _quoted(value, separator: str):
    """A field in quotation marks where it holds a separator, a quotation mark, a line break, or space at an end."""
    odd = value.rlike(f'[{re.escape(separator)}"\\r\\n]|^\\s|\\s$')
    return F.when(odd, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def _line(df: DataFrame, columns: list[str], separator: str):
    return F.concat_ws(separator, *[_quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), separator) for c in columns])


def _header(names: list[str], separator: str) -> str:
    return separator.join('"' + n.replace('"', '""') + '"' if re.search(f'[{re.escape(separator)}"\\r\\n]', n) else n for n in names)


def csv_lines(graph: Graph, separator: str = ",", target: str = "nodes") -> DataFrame:
    """(block, seq, line): the header and the rows of nodes, edges or both; nulls are empty, fields are quoted where they must be."""
    spark, out = graph.spark, None
    blocks = []
    if target != "edges":
        blocks.append((0, graph.nodes, ["id", "label", *graph.attributes("node")], ["Id", "Label", *graph.attributes("node")]))
    if target in ("edges", "both"):
        blocks.append((2, graph.edges, ["source", "target", "weight", *graph.attributes("edge")], ["Source", "Target", "Weight", *graph.attributes("edge")]))
    for block, df, columns, header in blocks:
        head = spark.createDataFrame([(block, -1, _header(header, separator))] + ([(1, 0, "")] if target == "both" and block == 0 else []), "block int, seq long, line string")
        rows = head.unionByName(df.select(F.lit(block).alias("block"), "seq", _line(df, columns, separator).alias("line")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("block", "seq").select("line").write.mode("overwrite").option("compression", "none").text(path)


def write_csv(graph: Graph, path: str, separator: str = ",", target: str = "nodes") -> None:
    _write_lines(csv_lines(graph, separator, target), path)


def merge(folder: str, file: str) -> None:
    """One file from a written folder on a file system the driver sees."""
    with open(file, "wb") as out:
        for part in sorted(glob.glob(os.path.join(folder, "part-*"))):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)


# ---------------------------------------------------------------- XML formats


def _xml(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _text(c: str):
    return _xml(F.col(f"`{c}`").cast("string"))


def _frame_rows(graph: Graph, head: list[str], nodes, middle: list[str], edges, tail: list[str]) -> DataFrame:
    fixed = [(b, i, line) for b, lines in ((0, head), (2, middle), (4, tail)) for i, line in enumerate(lines)]
    rows = graph.spark.createDataFrame(fixed, "block int, seq long, line string")
    return rows.unionByName(graph.nodes.select(F.lit(1).alias("block"), "seq", nodes.alias("line"))).unionByName(graph.edges.select(F.lit(3).alias("block"), "seq", edges.alias("line")))


def write_gexf(graph: Graph, path: str) -> None:
    """GEXF 1.3 with viz colours, sizes and positions."""
    kinds = {"node": dict(graph.nodes.dtypes), "edge": dict(graph.edges.dtypes)}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" xmlns:viz="http://gexf.net/1.3/viz" version="1.3">', '<graph defaultedgetype="directed">']
    for target in ("node", "edge"):
        head += [f'<attributes class="{target}" mode="static">', *[f'<attribute id="{c}" title="{c}" type="{_ATTRIBUTE_TYPES.get(kinds[target][c], "string")}"/>' for c in graph.attributes(target)], "</attributes>"]
    head.append("<nodes>")

    def values(target):
        parts = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'<attvalue for="{c}" value="'), _text(c), F.lit('"/>'))) for c in graph.attributes(target)]
        return F.concat(F.lit("<attvalues>"), F.concat_ws("", *parts), F.lit("</attvalues>")) if parts else F.lit("")

    paint = F.format_string('<viz:color r="%d" g="%d" b="%d" a="%s"/>', "r", "g", "b", F.round(F.col("a") / 255.0, 4).cast("string"))
    place = F.concat(F.lit('<viz:position x="'), F.col("x").cast("string"), F.lit('" y="'), F.col("y").cast("string"), F.lit('" z="0.0"/><viz:size value="'), F.col("size").cast("string"), F.lit('"/>'))
    node = F.concat(F.lit('<node id="'), _text("id"), F.lit('" label="'), F.coalesce(_text("label"), F.lit("")), F.lit('">'), values("node"), paint, place, F.lit("</node>"))
    edge = F.concat(
        F.lit('<edge id="'), F.col("seq").cast("string"), F.lit('" source="'), _text("source"), F.lit('" target="'), _text("target"), F.lit('" type="'), F.when(F.col("directed"), "directed").otherwise("undirected"),
        F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"'), F.coalesce(F.concat(F.lit(' label="'), _text("label"), F.lit('"')), F.lit("")), F.lit(">"), values("edge"), paint, F.lit("</edge>"),
    )
    _write_lines(_frame_rows(graph, head, node, ["</nodes>", "<edges>"], edge, ["</edges>", "</graph>", "</gexf>"]), path)


def _pivoted(df: DataFrame, kinds: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """One typed column for each declared attribute (title, type, default), from an array of (name, value)."""
    out = df.withColumn("__m", F.map_from_entries(F.array_distinct(F.coalesce("__values", F.array().cast("array<struct<k:string,v:string>>")))))
    for name, (title, kind, default) in kinds.items():
        value = F.coalesce(F.try_element_at("__m", F.lit(name)), F.lit(default).cast("string"))
        out = out.withColumn(title, value.try_cast(_BACK.get(kind, "string")))
    return out.drop("__m", "__values")


def _definitions(df: DataFrame) -> list:
    return df.collect()  # one row for each declared column, a header


def _graph_attribute(spark: SparkSession, path: str, name: str) -> str:
    """An attribute of the file's (first) graph element, in lower case; empty if it has none.  The file is read as text up to each ``>``, by several tasks."""
    tags = spark.read.option("lineSep", ">").text(path).where(r"value RLIKE '<graph(\\s|$)' AND NOT value RLIKE '<!--'")
    found = tags.select(F.lower(F.regexp_extract("value", rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1))).first()
    return found[0] if found else ""


def read_gexf(spark: SparkSession, path: str) -> Graph:
    """Nodes, edges, declared attributes with their defaults, and viz looks.

    An edge without a type has the graph's ``defaultedgetype``; where that is absent, too, it is directed.  A mutual edge is two, one each way.
    """
    values = "attvalues struct<attvalue: array<struct<_for: string, _value: string>>>"
    viz = "`viz:color` struct<_r: int, _g: int, _b: int, _a: double>, `viz:position` struct<_x: float, _y: float>, `viz:size` struct<_value: float>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, _label string, {values}, {viz}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, _type string, _weight double, _label string, {values}, `viz:color` struct<_r: int, _g: int, _b: int, _a: double>").load(path)
    defs = _definitions(spark.read.format("xml").option("rowTag", "attributes").schema("_class string, attribute array<struct<_id: string, _title: string, _type: string, default: string>>").load(path))
    kinds = {t: {a["_id"]: (a["_title"] or a["_id"], a["_type"] or "string", a["default"]) for d in defs if d["_class"] == t for a in d["attribute"] or []} for t in ("node", "edge")}
    entries = F.transform("attvalues.attvalue", lambda x: F.struct(x["_for"].alias("k"), x["_value"].alias("v"))).alias("__values")
    paint = [F.col("`viz:color`._r").alias("r"), F.col("`viz:color`._g").alias("g"), F.col("`viz:color`._b").alias("b"), F.coalesce(F.round(F.col("`viz:color`._a") * 255).cast("int"), F.lit(255)).alias("a")]
    n = nodes.where("_id IS NOT NULL").select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("`viz:position`._x").alias("x"), F.col("`viz:position`._y").alias("y"), F.col("`viz:size`._value").alias("size"), *paint, entries)
    kind = F.lower(F.coalesce("_type", F.lit(_graph_attribute(spark, path, "defaultedgetype") or "directed")))
    e = edges.where("_source IS NOT NULL").select(F.col("_source").alias("source"), F.col("_target").alias("target"), kind.alias("__kind"), (kind != "undirected").alias("directed"), F.coalesce("_weight", F.lit(1.0)).alias("weight"), F.col("_label").alias("label"), *paint, entries)
    back = e.where("__kind = 'mutual' AND source <> target").withColumns({"source": F.col("target"), "target": F.col("source")})
    e = e.unionByName(back).drop("__kind")
    return from_tables(with_seq(_pivoted(n, kinds["node"]), "id"), with_seq(_pivoted(e, kinds["edge"]), "source", "target"))


def write_graphml(graph: Graph, path: str) -> None:
    names = {"node": ["label", "x", "y", "size", "r", "g", "b", *graph.attributes("node")], "edge": ["weight", "label", *graph.attributes("edge")]}
    kinds = {"node": dict(graph.nodes.dtypes), "edge": dict(graph.edges.dtypes)}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for target, cols in names.items():
        head += [f'<key id="{target[0]}_{c}" for="{target}" attr.name="{c}" attr.type="{_ATTRIBUTE_TYPES.get(kinds[target][c], "string").replace("integer", "int")}"/>' for c in cols]
    head.append('<graph edgedefault="directed">')

    def data(target):
        parts = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'<data key="{target[0]}_{c}">'), _text(c), F.lit("</data>"))) for c in names[target]]
        return F.concat_ws("", *parts)

    node = F.concat(F.lit('<node id="'), _text("id"), F.lit('">'), data("node"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _text("source"), F.lit('" target="'), _text("target"), F.lit('" directed="'), F.col("directed").cast("string"), F.lit('">'), data("edge"), F.lit("</edge>"))
    _write_lines(_frame_rows(graph, head, node, [], edge, ["</graph>", "</graphml>"]), path)


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """Nodes, edges, and keys with their defaults; an edge that does not say has the graph's ``edgedefault``, and is directed where that is absent."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, _directed boolean, {data}").load(path)
    keys = _definitions(spark.read.format("xml").option("rowTag", "key").schema("_id string, _for string, `_attr.name` string, `_attr.type` string, default string").load(path))
    kinds = {t: {k["_id"]: (k["_attr.name"] or k["_id"], k["_attr.type"] or "string", k["default"]) for k in keys if k["_for"] in (t, "all", None)} for t in ("node", "edge")}
    entries = F.transform("data", lambda x: F.struct(x["_key"].alias("k"), x["_VALUE"].alias("v"))).alias("__values")
    n = _pivoted(nodes.where("_id IS NOT NULL").select(F.col("_id").alias("id"), entries), kinds["node"])
    e = _pivoted(edges.where("_source IS NOT NULL").select(F.col("_source").alias("source"), F.col("_target").alias("target"), F.coalesce("_directed", F.lit(_graph_attribute(spark, path, "edgedefault") != "undirected")).alias("directed"), entries), kinds["edge"])
    if "weight" in e.columns:
        e = e.withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    return from_tables(with_seq(n, "id"), with_seq(e, "source", "target"))


# ---------------------------------------------------------------- nested text formats


def _read_text(spark: SparkSession, path: str, kind: str) -> Graph:
    rows = parsed(spark, path, kind)
    looks = ["r", "g", "b"]
    # Of repeated nodes the last statement with a label or a place counts (Pajek numbers its vertices first).
    nodes = rows.where("kind = 'node'").groupBy("id").agg(F.max_by(F.struct("label", "x", "y", "size", *looks, "attributes"), F.struct(F.col("label").isNotNull(), F.col("x").isNotNull())).alias("n")).select("id", "n.*")
    nodes = with_attributes(nodes.withColumn("label", F.coalesce("label", "id")), NODE_BUILTIN)
    edges = with_attributes(rows.where("kind = 'edge'").select("source", "target", "label", "weight", "directed", *looks, "attributes"), EDGE_BUILTIN)
    grey = {c: F.coalesce(c, F.lit(153)) for c in looks}
    place = {c: F.coalesce(F.col(c).cast("float"), start_position(F.col("id"), c)) for c in ("x", "y")}
    nodes = nodes.withColumns(grey | place | {"size": F.coalesce(F.col("size").cast("float"), F.lit(10.0).cast("float"))})
    return from_tables(with_seq(nodes, "id"), with_seq(edges.withColumns(grey), "source", "target"))


def read_gml(spark: SparkSession, path: str) -> Graph:
    return _read_text(spark, path, "gml")


def read_dot(spark: SparkSession, path: str) -> Graph:
    return _read_text(spark, path, "dot")


def read_pajek(spark: SparkSession, path: str) -> Graph:
    return _read_text(spark, path, "net")


READERS = {"gexf": read_gexf, "graphml": read_graphml, "csv": read_csv, "gml": read_gml, "dot": read_dot, "gv": read_dot, "net": read_pajek}


def read_graph(spark: SparkSession, path: str, kind: str | None = None) -> Graph:
    """A graph file by its ending, or as the given format."""
    kind = (kind or re.sub(r".*\.", "", path.rstrip("/"))).lower()
    if kind not in READERS:
        raise GraphError(f"unknown graph format: {kind}")
    return READERS[kind](spark, path)


def merge_into(graph: Graph, new: Graph, cap: float = 30.0) -> Graph:
    """Add what is not there yet, then hold every node of the result at size ``cap`` or less."""
    start = with_seq(new.nodes.drop("seq"), "id").withColumnRenamed("seq", "__pos")
    out, _ = add_nodes_frame(graph, start)
    edges = with_seq(new.edges.drop("seq", "type"), "source", "target").withColumnRenamed("seq", "__pos")
    out, _ = add_edges_frame(out, edges)
    return out.with_(nodes=out.nodes.withColumn("size", F.least("size", F.lit(cap).cast("float"))))


# ---------------------------------------------------------------- projects


def save_project(workspaces: list[Graph], current: int, path: str, name: str = "") -> None:
    """All workspaces as Parquet folders, and a manifest as a text folder."""
    spark = workspaces[0].spark
    for i, g in enumerate(workspaces):
        g.nodes.write.mode("overwrite").parquet(f"{path}/workspace-{i}/nodes")
        g.edges.write.mode("overwrite").parquet(f"{path}/workspace-{i}/edges")
    manifest = json.dumps({"name": name, "current": current, "previews": [g.preview for g in workspaces]})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def open_project(spark: SparkSession, path: str) -> tuple[list[Graph], int, str]:
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        raise GraphError(f"no project at {path}") from e
    graphs = [Graph(spark.read.parquet(f"{path}/workspace-{i}/nodes"), spark.read.parquet(f"{path}/workspace-{i}/edges"), p) for i, p in enumerate(manifest["previews"])]
    return graphs, manifest["current"], manifest["name"]


