"""Pages of nodes and edges, schema and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EDGE_BUILTIN, NODE_BUILTIN, Graph, degrees

_SHORT = {"string": "String", "int": "Integer", "bigint": "Long", "float": "Float", "double": "Double", "boolean": "Boolean"}


def _attributes(graph: Graph, target: str):
    names = graph.attributes(target)
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("{}")


def query_nodes(graph: Graph, limit: int = 100, offset: int = 0, where=None) -> DataFrame:
    """A page of nodes in their order, with degree and the attributes that are not null; ``where`` is a Column or a {column: value} dict.

    Only the page's nodes are joined to edges.
    """
    nodes = graph.nodes
    if isinstance(where, dict):
        for c, v in where.items():
            nodes = nodes.where(F.col(f"`{c}`") == F.lit(v))
    elif where is not None:
        nodes = nodes.where(where)
    page = nodes.orderBy("seq", "id").offset(max(0, offset)).limit(max(0, limit))
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id"))
    degree = ends.join(F.broadcast(page.select("id")) if limit <= 10_000 else page.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").cast("int").alias("__degree"))
    out = page.withColumn("attributes", _attributes(graph, "node")).join(degree, "id", "left")
    return out.select("id", "label", "x", "y", "size", F.coalesce("__degree", F.lit(0)).alias("degree"), "r", "g", "b", "a", "attributes", "seq").orderBy("seq", "id").drop("seq")


def query_edges(graph: Graph, limit: int = 100, offset: int = 0, where=None) -> DataFrame:
    edges = graph.edges if where is None else graph.edges.where(where)
    page = edges.orderBy("seq", "source", "target").offset(max(0, offset)).limit(max(0, limit))
    return page.select("source", "target", "weight", "directed", "label", "r", "g", "b", _attributes(graph, "edge").alias("attributes"))


def columns(graph: Graph, target: str = "node") -> list[dict]:
    df, builtin = (graph.edges, EDGE_BUILTIN) if target == "edge" else (graph.nodes, NODE_BUILTIN)
    return [{"id": c, "title": c, "type": _SHORT.get(t, t), "property": c in builtin} for c, t in df.dtypes if c != "seq"]


def graph_type(graph: Graph) -> DataFrame:
    """(is_directed, is_undirected, is_mixed) of the edges; an empty graph counts as directed."""
    every = graph.edges.agg(F.coalesce(F.bool_and("directed"), F.lit(True)).alias("is_directed"), F.coalesce(F.bool_and(~F.col("directed")), F.lit(False)).alias("is_undirected"))
    return every.withColumn("is_mixed", ~F.col("is_directed") & ~F.col("is_undirected"))


def graph_stats(graph: Graph, directed_density: bool = False) -> DataFrame:
    """(node_count, edge_count, density, average_degree, is_directed) in one row; both counts in one pass over a union."""
    rows = graph.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e"), F.lit(None).cast("boolean").alias("d")).unionByName(graph.edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"), F.col("directed").alias("d")))
    counts = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"), F.coalesce(F.bool_and("d"), F.lit(True)).alias("is_directed"))
    n, e = F.col("node_count").cast("double"), F.col("edge_count").cast("double")
    density = F.when(n > 1, e * (1.0 if directed_density else 2.0) / (n * (n - 1))).otherwise(0.0)
    return counts.select("node_count", "edge_count", density.alias("density"), F.when(n > 0, 2.0 * e / n).otherwise(0.0).alias("average_degree"), "is_directed")


def with_degrees(graph: Graph) -> DataFrame:
    return graph.nodes.drop("degree", "indegree", "outdegree").join(degrees(graph), "id")
