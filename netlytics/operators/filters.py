"""Subgraphs: by degree, weight, neighbourhood and component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, degrees, durable
from .components import connected_components
from .edit import need_node


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The nodes whose id is in ``keep`` and the edges between them."""
    ids = keep.select(F.col("id").alias("__id"))
    edges = graph.edges.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
    return graph.with_(nodes=graph.nodes.join(ids, F.col("id") == F.col("__id"), "left_semi"), edges=edges)


def filter_by_degree(graph: Graph, min: int = 0, max: int = 0) -> Graph:
    """Nodes with min <= degree <= max (max 0: no bound), by the degrees before the filter."""
    d = degrees(graph)
    return induced(graph, d.where((F.col("degree") >= min) & (F.lit(max <= 0) | (F.col("degree") <= max))))


def filter_by_edge_weight(graph: Graph, min: float = 0.0, max: float = 0.0) -> Graph:
    """Edges with min <= weight <= max (max 0: no bound); nodes stay."""
    keep = F.col("weight") >= min
    return graph.with_(edges=graph.edges.where(keep & (F.col("weight") <= max) if max > 0 else keep))


def remove_isolates(graph: Graph) -> Graph:
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph.with_(nodes=graph.nodes.join(ends, "id", "left_semi"))


def ego_ids(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    """Ids within ``depth`` steps of a node, whichever way edges point."""
    need_node(graph, node_id)
    both = durable(graph.edges.select(F.col("source").alias("s"), F.col("target").alias("t")).unionByName(graph.edges.select(F.col("target").alias("s"), F.col("source").alias("t"))))
    found = frontier = graph.spark.createDataFrame([(node_id,)], "id string")
    for _ in range(depth):
        frontier = durable(both.join(frontier, F.col("s") == F.col("id"), "left_semi").select(F.col("t").alias("id")).distinct().join(found, "id", "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def ego_network(graph: Graph, node_id: str, depth: int = 1) -> Graph:
    return induced(graph, ego_ids(graph, node_id, depth))


def giant_component(graph: Graph) -> tuple[Graph, dict]:
    """The largest component (of equals the first), with componentnumber on its nodes."""
    numbered = connected_components(graph)
    sizes = durable(numbered.nodes.groupBy("componentnumber").agg(F.count("*").alias("n")))
    best = sizes.orderBy(F.desc("n"), "componentnumber").first()
    if best is None:
        return numbered, {"kept_nodes": 0, "removed_nodes": 0, "component_count": 0}
    total = sizes.agg(F.sum("n"), F.count("*")).first()
    kept = induced(numbered, numbered.nodes.where(F.col("componentnumber") == best[0]))
    return kept, {"kept_nodes": best[1], "removed_nodes": total[0] - best[1], "component_count": total[1]}


def reset_filters(graph: Graph) -> Graph:
    """Filters make new graphs, so there is nothing to reset; ``Graph.undo`` takes one back."""
    return graph
