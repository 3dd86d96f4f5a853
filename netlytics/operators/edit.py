"""Changes of nodes, edges and attributes, each one a join for the whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import coerce, text_of, type_named, type_of
from ..graph import EDGE_BUILTIN, NODE_BUILTIN, Graph, GraphError, edge_frame, node_frame

_POS = "__pos"


def _next_seq(df: DataFrame) -> int:
    return (df.agg(F.max("seq")).first()[0] or 0) + 1


def _batch(graph: Graph, rows: list[tuple], schema: str) -> DataFrame:
    return graph.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{_POS} long, {schema}")


def _first(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(_POS))).where("__n = 1").drop("__n")


def _last(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(_POS)))).where("__n = 1").drop("__n")


def has_node(graph: Graph, node_id: str) -> bool:
    return not graph.nodes.where(F.col("id") == node_id).isEmpty()


def need_node(graph: Graph, node_id: str) -> None:
    if not has_node(graph, node_id):
        raise GraphError(f"node not found: {node_id}")


def _edge_at(source: str, target: str):
    return (F.col("source") == source) & (F.col("target") == target)


def _edge_seq(graph: Graph, source: str, target: str) -> int:
    """The edge that a (source, target) pair means: the directed one before the undirected one before others."""
    rank = F.when(F.col("type") == 1, 0).when(F.col("type") == 0, 1).otherwise(2)
    found = graph.edges.where(_edge_at(source, target)).orderBy(rank, "seq").select("seq").first()
    if not found:
        raise GraphError(f"edge not found: {source} -> {target}")
    return found[0]


# ---------------------------------------------------------------- nodes


def add_nodes_frame(graph: Graph, new: DataFrame) -> tuple[Graph, DataFrame]:
    """Insert rows (id, label, position in the batch ``__pos``, attributes…): the first of each id that is not there yet."""
    fresh = _first(new.where("id IS NOT NULL"), "id").join(graph.nodes.select("id"), "id", "left_anti")
    start = _next_seq(graph.nodes)
    rows = node_frame(fresh.withColumn("seq", F.col(_POS) + start).drop(_POS))
    return graph.with_(nodes=graph.nodes.unionByName(rows, allowMissingColumns=True)), rows


def add_nodes(graph: Graph, nodes: list[dict]) -> tuple[Graph, dict]:
    """Batch insert; null, known and repeated ids are skipped, an absent label is the id, an explicit null stays."""
    batch = _batch(graph, [(n.get("id"), n.get("label", n.get("id"))) for n in nodes], "id string, label string")
    out, rows = add_nodes_frame(graph, batch)
    added = rows.count()
    updates = [{"id": n["id"], "attributes": n["attributes"]} for n in nodes if n.get("attributes") and n.get("id") is not None]
    if updates:
        out = set_attributes(out, updates)[0]
    return out, {"added": added, "skipped": len(nodes) - added}


def add_node(graph: Graph, id: str, label: str | None = None, attributes: dict | None = None) -> Graph:
    if has_node(graph, id):
        raise GraphError(f"node already exists: {id}")
    out = add_nodes(graph, [{"id": id, "label": label if label is not None else id}])[0]
    return set_attributes(out, [{"id": id, "attributes": attributes}])[0] if attributes else out


def remove_nodes_frame(graph: Graph, ids: DataFrame) -> Graph:
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    nodes = graph.nodes.join(gone, F.col("id") == F.col("__gone"), "left_anti")
    edges = graph.edges.join(gone, F.col("source") == F.col("__gone"), "left_anti").join(gone, F.col("target") == F.col("__gone"), "left_anti")
    return graph.with_(nodes=nodes, edges=edges)


def bulk_remove_nodes(graph: Graph, ids: list[str]) -> tuple[Graph, dict]:
    frame = graph.spark.createDataFrame([(i,) for i in ids], "id string")
    removed = graph.nodes.join(frame.distinct(), "id", "left_semi").count()
    return remove_nodes_frame(graph, frame), {"removed": removed, "not_found": len(ids) - removed}


def remove_node(graph: Graph, id: str) -> tuple[Graph, dict]:
    need_node(graph, id)
    edges = graph.edges.where((F.col("source") == id) | (F.col("target") == id)).count()
    return remove_nodes_frame(graph, graph.spark.createDataFrame([(id,)], "id string")), {"edges_removed": edges}


def update_node(graph: Graph, id: str, **values) -> Graph:
    """Set built-in columns of one node."""
    need_node(graph, id)
    kinds = dict(graph.nodes.dtypes)
    return graph.with_(nodes=graph.nodes.withColumns({c: F.when(F.col("id") == id, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}))


def update_nodes_frame(graph: Graph, updates: DataFrame, columns: list[str]) -> Graph:
    """Set columns from rows (id, …, ``__pos``): the last row of each id wins."""
    kinds = dict(graph.nodes.dtypes)
    last = _last(updates, "id").select(F.col("id").alias("__id"), *[F.col(c).cast(kinds[c]).alias(f"__{c}") for c in columns])
    joined = graph.nodes.join(last, F.col("id") == F.col("__id"), "left")
    out = [F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in graph.nodes.columns]
    return graph.with_(nodes=joined.select(*out))


def _update_counts(graph: Graph, updates: DataFrame, total: int) -> dict:
    done = updates.join(graph.nodes.select("id"), "id", "left_semi").count()
    return {"set": done, "not_found": total - done}


def batch_set_positions(graph: Graph, positions: list[dict]) -> tuple[Graph, dict]:
    batch = _batch(graph, [(p["id"], float(p["x"]), float(p["y"])) for p in positions], "id string, x float, y float")
    return update_nodes_frame(graph, batch, ["x", "y"]), _update_counts(graph, batch, len(positions))


def batch_set_node_colors(graph: Graph, nodes: list[dict]) -> tuple[Graph, dict]:
    batch = _batch(graph, [(n["id"], n["r"], n["g"], n["b"], n.get("a", 255)) for n in nodes], "id string, r int, g int, b int, a int")
    return update_nodes_frame(graph, batch, ["r", "g", "b", "a"]), _update_counts(graph, batch, len(nodes))


# ---------------------------------------------------------------- edges


def add_edges_frame(graph: Graph, new: DataFrame) -> tuple[Graph, DataFrame]:
    """Insert rows (source, target, weight, directed, ``__pos``): known ends, and pairs that are not there yet."""
    fresh = _first(new.where("source IS NOT NULL AND target IS NOT NULL"), "source", "target")
    ids = graph.nodes.select(F.col("id").alias("__id"))
    fresh = fresh.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
    fresh = fresh.join(graph.edges.select("source", "target"), ["source", "target"], "left_anti")
    rows = edge_frame(fresh.withColumn("seq", F.col(_POS) + _next_seq(graph.edges)).drop(_POS))
    return graph.with_(edges=graph.edges.unionByName(rows, allowMissingColumns=True)), rows


def add_edges(graph: Graph, edges: list[dict]) -> tuple[Graph, dict]:
    batch = _batch(graph, [(e.get("source"), e.get("target"), float(e.get("weight", 1.0)), bool(e.get("directed", True))) for e in edges], "source string, target string, weight double, directed boolean")
    out, rows = add_edges_frame(graph, batch)
    added = rows.count()
    return out, {"added": added, "skipped": len(edges) - added}


def add_edge(graph: Graph, source: str, target: str, weight: float = 1.0, directed: bool = True) -> Graph:
    need_node(graph, source)
    need_node(graph, target)
    if not graph.edges.where(_edge_at(source, target)).isEmpty():
        raise GraphError(f"edge already exists: {source} -> {target}")
    return add_edges(graph, [{"source": source, "target": target, "weight": weight, "directed": directed}])[0]


def remove_edge(graph: Graph, source: str, target: str) -> Graph:
    seq = _edge_seq(graph, source, target)
    return graph.with_(edges=graph.edges.where(~(_edge_at(source, target) & (F.col("seq") == seq))))


def update_edge(graph: Graph, source: str, target: str, **values) -> Graph:
    at = _edge_at(source, target) & (F.col("seq") == _edge_seq(graph, source, target))
    kinds = dict(graph.edges.dtypes)
    return graph.with_(edges=graph.edges.withColumns({c: F.when(at, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}))


def clear(graph: Graph) -> tuple[Graph, dict]:
    counts = {"nodes_removed": graph.nodes.count(), "edges_removed": graph.edges.count()}
    return graph.with_(nodes=graph.nodes.where(F.lit(False)), edges=graph.edges.where(F.lit(False))), counts


# ---------------------------------------------------------------- attributes


def add_column(graph: Graph, name: str, type: str, target: str = "node") -> Graph:
    df = graph.edges if target == "edge" else graph.nodes
    if name in df.columns:
        raise GraphError(f"column already exists: {name}")
    df = df.withColumn(name, F.lit(None).cast(type_named(type)))
    return graph.with_(edges=df) if target == "edge" else graph.with_(nodes=df)


def _ensure(graph: Graph, attributes: dict, target: str) -> Graph:
    """Columns for new names, of the type of the first value."""
    builtin = EDGE_BUILTIN if target == "edge" else NODE_BUILTIN
    for name, value in attributes.items():
        df = graph.edges if target == "edge" else graph.nodes
        if name in builtin and name in ("id", "seq", "source", "target", "type", "directed"):
            raise GraphError(f"not an attribute: {name}")
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(type_of(value)))
            graph = graph.with_(edges=df) if target == "edge" else graph.with_(nodes=df)
    return graph


def set_attributes(graph: Graph, updates: list[dict]) -> tuple[Graph, dict]:
    """Batch upsert of node attributes [{id, attributes}]; the last value of each (id, name) wins, a row without attributes counts as set."""
    names: dict[str, object] = {}
    for u in updates:
        for k, v in (u.get("attributes") or {}).items():
            names.setdefault(k, v)
    out = _ensure(graph, names, "node")
    flat = [(u["id"], k, text_of(v)) for u in updates for k, v in (u.get("attributes") or {}).items()]
    ids = graph.spark.createDataFrame([(u["id"],) for u in updates], "id string")
    done = ids.join(graph.nodes.select("id"), "id", "left_semi").count()
    if flat:
        cells = _last(_batch(graph, flat, "id string, name string, value string"), "id", "name")
        wide = cells.groupBy("id").pivot("name", list(names)).agg(F.struct(F.first("value").alias("v"), F.lit(True).alias("set")))
        wide = wide.select(F.col("id").alias("__id"), *[F.col(f"`{c}`").alias(f"__new_{i}") for i, c in enumerate(names)])
        joined = out.nodes.join(wide, F.col("id") == F.col("__id"), "left")
        at = {c: i for i, c in enumerate(names)}
        cols = [F.when(F.col(f"__new_{at[f.name]}.set"), coerce(F.col(f"__new_{at[f.name]}.v"), f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in at else F.col(f"`{f.name}`") for f in out.nodes.schema]
        out = out.with_(nodes=joined.select(*cols))
    return out, {"set": done, "not_found": len(updates) - done}


def set_node_attributes(graph: Graph, id: str, attributes: dict) -> Graph:
    need_node(graph, id)
    return set_attributes(graph, [{"id": id, "attributes": attributes}])[0]


def set_edge_attributes(graph: Graph, source: str, target: str, attributes: dict) -> Graph:
    out = _ensure(graph, attributes, "edge")
    at = _edge_at(source, target) & (F.col("seq") == _edge_seq(out, source, target))
    kinds = {f.name: f.dataType for f in out.edges.schema}
    return out.with_(edges=out.edges.withColumns({c: F.when(at, coerce(F.lit(text_of(v)).cast("string"), kinds[c])).otherwise(F.col(f"`{c}`")) for c, v in attributes.items()}))
