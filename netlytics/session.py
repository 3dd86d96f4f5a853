"""Projects with workspaces, and every operator by its name with the plain-result envelope."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph as G
from .operators import appearance as A
from .operators import edit as E
from .operators import filters as FI
from .operators import layout as L
from .operators import preview as P
from .operators import query as Q
from .operators import statistics as S
from .sources import drawing as D
from .sources import tables as IO


class Session:
    """A project: a list of graphs of which one is current.  Changes replace the current graph; ``undo`` takes the last one back."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, ""
        self.workspaces: list[tuple[int, G.Graph]] = []
        self.current, self.next_id = -1, 1
        self.job = L.LayoutJob()

    # -- catalog

    @property
    def graph(self) -> G.Graph:
        if self.current < 0:
            raise G.GraphError("No project open")
        return self.workspaces[self.current][1]

    @graph.setter
    def graph(self, value: G.Graph) -> None:
        self.workspaces[self.current] = (self.workspaces[self.current][0], value)

    def create_project(self, name: str = "") -> dict:
        self.name, self.workspaces, self.current = name, [], -1
        self._append(G.empty(self.spark))
        return {"name": name}

    def _append(self, graph: G.Graph) -> int:
        self.workspaces.append((self.next_id, graph))
        self.next_id += 1
        self.current = len(self.workspaces) - 1
        return self.workspaces[-1][0]

    def open_project(self, file: str) -> dict:
        graphs, current, self.name = IO.open_project(self.spark, file)
        self.workspaces = []
        for g in graphs:
            self._append(g)
        self.current = current
        return {"workspaces": len(graphs)}

    def save_project(self, file: str) -> dict:
        self.graph  # noqa: B018  raises without a project
        IO.save_project([g for _, g in self.workspaces], self.current, file, self.name)
        return {"file": file}

    def get_project_info(self) -> dict:
        if self.current < 0:
            return {"has_project": False}
        s, t = Q.graph_stats(self.graph).first(), Q.graph_type(self.graph).first()
        return {"has_project": True, "name": self.name, "workspace_id": self.workspaces[self.current][0], "node_count": s["node_count"], "edge_count": s["edge_count"], "is_directed": t["is_directed"], "is_mixed": t["is_mixed"]}

    def new_workspace(self) -> dict:
        self.graph  # noqa: B018
        return {"workspace_id": self._append(G.empty(self.spark))}

    def list_workspaces(self) -> dict:
        self.graph  # noqa: B018
        return {"workspaces": [{"id": i, "current": k == self.current} for k, (i, _) in enumerate(self.workspaces)]}

    def _at(self, index: int) -> int:
        self.graph  # noqa: B018
        if not 0 <= int(index) < len(self.workspaces):
            raise G.GraphError(f"no workspace at position {index}")
        return int(index)

    def switch_workspace(self, index: int) -> dict:
        self.current = self._at(index)
        return {"workspace_id": self.workspaces[self.current][0]}

    def delete_workspace(self, index: int = 0) -> dict:
        i = self._at(index)
        gone = self.workspaces.pop(i)[0]
        self.current = min(self.current - (i < self.current), len(self.workspaces) - 1)
        return {"deleted": gone}

    def undo(self) -> dict:
        self.graph = self.graph.undo()
        return {}

    # -- operators by name

    def _change(self, result) -> dict:
        graph, more = result if isinstance(result, tuple) else (result, {})
        # Changes are made at once, so that plans do not pile up over a long session.
        self.graph = graph if graph is self.graph else graph.checkpoint()
        return more

    def _filtered(self, graph: G.Graph) -> dict:
        before = self.graph.nodes.count(), self.graph.edges.count()
        self.graph = graph.checkpoint()
        after = self.graph.nodes.count(), self.graph.edges.count()
        return {"removed": before[0] - after[0], "removed_edges": before[1] - after[1], "remaining_nodes": after[0], "remaining_edges": after[1]}

    def _statistic(self, compute, **options) -> dict:
        graph, scalars = compute(self.graph, **options)
        self.graph = graph.checkpoint()
        return scalars

    def _import(self, file: str, kind: str | None = None) -> dict:
        new = IO.read_graph(self.spark, file, kind)
        if self.current < 0:
            self.create_project()
        self.graph = IO.merge_into(self.graph, new).checkpoint()
        return {"node_count": self.graph.nodes.count(), "edge_count": self.graph.edges.count()}

    def _export(self, write: Callable, file: str, **options) -> dict:
        write(self.graph, file, **options)
        return {"file": file}

    def _page(self, rows: DataFrame, total: int, name: str) -> dict:
        found = [r.asDict() for r in rows.collect()]  # one page
        return {name: found, "count": len(found), "total": total}

    def _run_layout(self, algorithm: str, iterations: int = 1000, properties: dict | None = None) -> dict:
        own = self.workspaces[self.current][0] if self.current >= 0 else None

        def done(graph):
            """Only positions go back, to the workspace the layout began in if it is still there: edits made meanwhile stay."""
            for k, (i, now) in enumerate(self.workspaces):
                if i == own:
                    self.workspaces[k] = (i, L.take_positions(now, graph).checkpoint())

        self.job.start(self.graph, algorithm, iterations, properties, done)
        return {"status": "running", "layout": self.job.name}

    def operators(self) -> dict[str, Callable[..., dict]]:
        g = lambda: self.graph
        change = lambda f: lambda **k: self._change(f(g(), **k))
        statistic = lambda f: lambda **k: self._statistic(f, **k)
        reader = lambda kind: lambda file: self._import(file, kind)
        writer = lambda f: lambda file, **k: self._export(f, file, **k)
        number = lambda v, d: int(v) if str(v).lstrip("-").isdigit() else d
        return {
            "import_file": reader(None), "import_gexf": reader("gexf"), "import_graphml": reader("graphml"), "import_csv": reader("csv"),
            "open_project": self.open_project, "health_check": lambda: {"service": "netlytics", "version": "1.0", "status": "running"},
            "save_project": self.save_project, "export_csv": writer(IO.write_csv), "export_gexf": writer(IO.write_gexf), "export_graphml": writer(IO.write_graphml),
            "export_svg": writer(D.write_svg), "export_png": writer(D.write_png), "export_pdf": writer(D.write_pdf),
            "query_nodes": lambda limit=100, offset=0, where=None: self._page(Q.query_nodes(g(), number(limit, 100), number(offset, 0), where), g().nodes.count(), "nodes"),
            "query_edges": lambda limit=100, offset=0, where=None: self._page(Q.query_edges(g(), number(limit, 100), number(offset, 0), where), g().edges.count(), "edges"),
            "get_columns": lambda target="node": {"columns": Q.columns(g(), target)},
            "get_project_info": self.get_project_info, "get_graph_type": lambda: Q.graph_type(g()).first().asDict(),
            "add_node": change(E.add_node), "add_nodes": change(E.add_nodes), "remove_node": change(E.remove_node), "bulk_remove_nodes": change(E.bulk_remove_nodes),
            "set_node_label": lambda id, label: self._change(E.update_node(g(), id, label=label)),
            "set_node_position": lambda id, x=0.0, y=0.0: self._change(E.update_node(g(), id, x=float(x), y=float(y))),
            "batch_set_positions": change(E.batch_set_positions), "add_edge": change(E.add_edge), "add_edges": change(E.add_edges), "remove_edge": change(E.remove_edge),
            "set_edge_weight": lambda source, target, weight: self._change(E.update_edge(g(), source, target, weight=float(weight))),
            "set_edge_label": lambda source, target, label: self._change(E.update_edge(g(), source, target, label=label)),
            "clear_graph": change(E.clear), "add_column": change(E.add_column), "set_node_attributes": change(E.set_node_attributes),
            "batch_set_node_attributes": change(E.set_attributes), "set_edge_attributes": change(E.set_edge_attributes),
            "get_graph_stats": lambda: Q.graph_stats(g()).first().asDict(),
            "compute_degree": statistic(S.compute_degree), "compute_connected_components": statistic(S.compute_connected_components), "compute_modularity": statistic(S.compute_modularity),
            "compute_betweenness": statistic(S.compute_betweenness), "compute_avg_path_length": statistic(S.compute_avg_path_length), "compute_pagerank": statistic(S.compute_pagerank),
            "compute_eigenvector": statistic(S.compute_eigenvector), "compute_hits": statistic(S.compute_hits), "compute_clustering_coefficient": statistic(S.compute_clustering_coefficient),
            "filter_by_degree": lambda **k: self._filtered(FI.filter_by_degree(g(), **k)), "filter_by_edge_weight": lambda **k: self._filtered(FI.filter_by_edge_weight(g(), **k)),
            "remove_isolates": lambda: self._filtered(FI.remove_isolates(g())), "extract_ego_network": lambda node_id, depth=1: self._filtered(FI.ego_network(g(), node_id, depth)),
            "extract_giant_component": change(FI.giant_component), "reset_filters": change(FI.reset_filters),
            "color_by_partition": change(A.color_by_partition), "color_by_ranking": change(A.color_by_ranking), "size_by_ranking": change(A.size_by_ranking),
            "edge_thickness_by_weight": change(A.edge_thickness_by_weight), "set_node_color": change(A.set_node_color), "set_node_size": change(A.set_node_size),
            "set_edge_color": change(A.set_edge_color), "batch_set_node_colors": change(E.batch_set_node_colors), "reset_appearance": change(A.reset_appearance),
            "get_preview_settings": lambda: {"settings": P.get_preview_settings(g())}, "set_preview_settings": lambda **k: self._change(P.set_preview_settings(g(), k)),
            "run_layout": self._run_layout, "set_layout_properties": self._run_layout, "get_layout_properties": lambda algorithm: {"properties": L.layout_properties(algorithm)},
            "get_available_layouts": lambda: {"layouts": L.available_layouts()}, "get_layout_status": self.job.status, "stop_layout": lambda: self.job.stop() or {},
            "create_project": self.create_project, "new_workspace": self.new_workspace, "list_workspaces": self.list_workspaces,
            "switch_workspace": self.switch_workspace, "delete_workspace": self.delete_workspace,
        }

    def call(self, operator: str, **parameters) -> dict:
        """{"success": true, …} or {"success": false, "error": …}."""
        run = self.operators().get(operator)
        if run is None:
            return {"success": False, "error": f"unknown operator: {operator}"}
        try:
            inspect.signature(run).bind(**parameters)
        except TypeError as e:
            return {"success": False, "error": f"Missing or unknown parameter: {e}"}
        try:
            return {"success": True} | run(**parameters)
        except Exception as e:  # whatever goes wrong is an answer, not an end of the session
            return {"success": False, "error": str(e) or type(e).__name__}
