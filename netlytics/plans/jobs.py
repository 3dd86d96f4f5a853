"""Whole workflows in a session: import and explore, communities, the recommended order of statistics, pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import GraphError
from ..operators.appearance import COMMUNITY_PALETTE
from ..session import Session
from .reports import quality_band

#: The order in which statistics are best run.
RECOMMENDED_ORDER = (
    "compute_degree", "compute_connected_components", "compute_modularity", "compute_betweenness",
    "compute_pagerank", "compute_clustering_coefficient", "compute_eigenvector", "compute_hits",
)
#: Preview settings for a picture without labels, and what changes for one with labels.
CLEAN = {"node.label.show": False, "edge.opacity": 25, "edge.curved": True, "edge.color": "source", "edge.thickness": 2.0, "node.opacity": 100, "node.border.width": 0.3, "arrow.size": 0}
LABELLED = {"node.label.show": True, "node.label.proportinalSize": False, "node.label.font": "Arial 10 Plain", "node.label.outline.size": 4, "node.label.outline.opacity": 95, "edge.opacity": 15}


def _do(session: Session, operator: str, **parameters) -> dict:
    out = session.call(operator, **parameters)
    if not out.pop("success"):
        raise GraphError(f"{operator}: {out['error']}")
    return out


def _layout(session: Session, scaling: float, iterations: int) -> None:
    """ForceAtlas 2 for communities, to its end."""
    properties = {"scalingRatio": scaling, "linLogMode": True, "gravity": 1.0, "barnesHutOptimize": True}
    _do(session, "run_layout", algorithm="ForceAtlas 2", iterations=iterations, properties=properties)
    session.job.thread.join()
    if "error" in (status := _do(session, "get_layout_status")):
        raise GraphError(status["error"])


def _style(session: Session) -> None:
    colors = {str(i): list(c) for i, c in enumerate(COMMUNITY_PALETTE)}
    _do(session, "color_by_partition", column="modularity_class", colors=colors)
    _do(session, "size_by_ranking", column="degree", min_size=3, max_size=25)


def community_sizes(session: Session) -> DataFrame:
    """(modularity_class, size), of all nodes."""
    return session.graph.nodes.groupBy("modularity_class").agg(F.count("*").alias("size"))


def community_detection(session: Session, resolution: float = 1.0, iterations: int = 1500) -> tuple[dict, DataFrame]:
    """Communities found, coloured, sized by degree and laid out: the scalars with a quality band, and the sizes."""
    found = _do(session, "compute_modularity", resolution=resolution)
    _do(session, "compute_degree")
    _style(session)
    _layout(session, 200, iterations)
    band = session.spark.range(1).select(quality_band(F.lit(found["modularity"]))).first()[0]
    return found | {"quality": band}, community_sizes(session)


def import_and_explore(session: Session, file: str, iterations: int = 1000) -> dict:
    """A file in a new project: counts, first statistics, isolates removed, style and layout."""
    _do(session, "create_project", name=file)
    _do(session, "import_file", file=file)
    out = {k: v for k, v in _do(session, "get_project_info").items() if k in ("is_directed", "is_mixed")}
    out |= _do(session, "get_graph_stats")
    for operator in ("compute_degree", "compute_modularity", "compute_connected_components"):
        out |= _do(session, operator)
    out["isolates_removed"] = _do(session, "remove_isolates")["removed"]
    _style(session)
    _layout(session, 100, iterations)
    return out


def recommended_order(session: Session, options: dict[str, dict] | None = None) -> dict:
    """All statistics in the recommended order; ``options`` by operator.  Their columns are on the nodes."""
    out = {}
    for operator in RECOMMENDED_ORDER:
        out |= _do(session, operator, **(options or {}).get(operator, {}))
    return out


def visualise(session: Session, base: str, width: int = 3840, height: int = 2160) -> dict[str, str]:
    """A clean PNG, a labelled one, and an SVG; an error of one does not stop the others.  {what: file or error}."""
    if not session.graph.nodes.head(1):
        raise GraphError("the graph is empty")
    out = {}

    def export(name: str, operator: str, file: str, **options) -> None:
        done = session.call(operator, file=file, **options)
        out[name] = done["file"] if done["success"] else f"error: {done['error']}"

    _do(session, "set_preview_settings", **CLEAN)
    export("clean", "export_png", f"{base}.png", width=width, height=height)
    _do(session, "set_preview_settings", **LABELLED)
    export("labelled", "export_png", f"{base}_labeled.png", width=width, height=height)
    export("svg", "export_svg", f"{base}.svg")
    return out
