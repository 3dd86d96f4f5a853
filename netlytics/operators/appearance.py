"""Colours, sizes and thickness from attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import check_colour
from ..graph import Graph, GraphError, with_seq
from .edit import update_edge, update_node

#: The default palette of partitions, in order.
PALETTE = [
    (31, 119, 180), (255, 127, 14), (44, 160, 44),
    (214, 39, 40), (148, 103, 189), (140, 86, 75),
    (227, 119, 194), (127, 127, 127), (188, 189, 34),
    (23, 190, 207), (174, 199, 232), (255, 187, 120),
]
#: The palette of communities, in order.
COMMUNITY_PALETTE = [(212, 222, 99), (227, 185, 216), (89, 238, 200), (154, 226, 255), (255, 171, 125), (255, 173, 203), (255, 220, 130), (190, 170, 230)]
_NUMERIC = {"int", "bigint", "float", "double", "smallint", "tinyint"}


def color_by_partition(graph: Graph, column: str, colors: dict | None = None, palette: list | None = None) -> tuple[Graph, dict]:
    """A colour for each value: given ones, or the palette over and over in the order in which values first appear. Values without a colour keep theirs."""
    if column not in graph.nodes.columns:
        raise GraphError(f"unknown column: {column}")
    value = F.col(f"`{column}`").cast("string")
    spark = graph.spark
    if colors:
        for c in colors.values():
            check_colour(*c)
        table = spark.createDataFrame([(str(k), *map(int, v)) for k, v in colors.items()], "__v string, __r int, __g int, __b int")
        n = len(colors)
    else:
        palette = palette or PALETTE
        firsts = graph.nodes.where(value.isNotNull()).groupBy(value.alias("__v")).agg(F.min("seq").alias("__first"))
        numbered = with_seq(firsts, "__first")
        shades = spark.createDataFrame([(i, *c) for i, c in enumerate(palette)], "__i long, __r int, __g int, __b int")
        table = numbered.join(F.broadcast(shades), F.col("seq") % len(palette) == F.col("__i")).select("__v", "__r", "__g", "__b")
        n = numbered.count()
    joined = graph.nodes.join(table, value == F.col("__v"), "left")
    cols = [F.coalesce(f"__{c}", c).alias(c) if c in ("r", "g", "b") else F.when(F.col("__v").isNotNull(), 255).otherwise(F.col("a")).alias("a") if c == "a" else F.col(f"`{c}`") for c in graph.nodes.columns]
    return graph.with_(nodes=joined.select(*cols)), {"partitions": n}


def _scaled(graph: Graph, column: str, compat: bool) -> tuple[DataFrame, object]:
    """Nodes with ``__t``, the column's place between its least and greatest number (NaN not counted; no range: 1 wide)."""
    kind = dict(graph.nodes.dtypes).get(column)
    if kind is None:
        raise GraphError(f"unknown column: {column}")
    if kind not in _NUMERIC:
        raise GraphError(f"not a numeric column: {column}")
    v = F.col(f"`{column}`").cast("double")
    number = F.when(~F.isnan(v), v)
    low, high = graph.nodes.agg(F.min(number), F.max(number)).first()
    if low is None:
        return graph.nodes.withColumn("__t", F.lit(None).cast("double")), F.lit(False)
    if compat:
        high = max(high, 5e-324)
    width = high - low or 1.0
    t = F.when(F.isnan(v), 0.0).otherwise((v - F.lit(low)) / F.lit(width))
    return graph.nodes.withColumn("__t", t), F.col("__t").isNotNull()


def color_by_ranking(graph: Graph, column: str, r_min=255, g_min=255, b_min=200, r_max=255, g_max=0, b_max=0, compat: bool = False) -> Graph:
    """Channels between two colours by rank, cut to whole numbers; nodes without a value keep theirs."""
    nodes, known = _scaled(graph, column, compat)

    def channel(low, high, old):
        x = F.lit(float(low)) + F.col("__t") * F.lit(float(high - low))
        return F.when(known, F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)).cast("int")).otherwise(F.col(old))

    out = nodes.withColumns({"r": channel(r_min, r_max, "r"), "g": channel(g_min, g_max, "g"), "b": channel(b_min, b_max, "b"), "a": F.when(known, 255).otherwise(F.col("a"))})
    return graph.with_(nodes=out.drop("__t"))


def size_by_ranking(graph: Graph, column: str, min_size: float = 5.0, max_size: float = 50.0, compat: bool = False) -> Graph:
    nodes, known = _scaled(graph, column, compat)
    size = (F.lit(float(min_size)) + F.col("__t") * F.lit(float(max_size - min_size))).cast("float")
    return graph.with_(nodes=nodes.withColumn("size", F.when(known, size).otherwise(F.col("size"))).drop("__t"))


def edge_thickness(graph: Graph) -> DataFrame:
    """(seq, thickness): the weight, or its place between the preview's bounds where rescaling is on."""
    p = graph.preview
    if not p.get("edge.rescale-weight"):
        return graph.edges.select("seq", (F.col("weight") * float(p.get("edge.thickness", 1.0))).alias("thickness"))
    low, high = float(p.get("edge.rescale-weight.min", 1.0)), float(p.get("edge.rescale-weight.max", 5.0))
    bounds = graph.edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    lo, hi = bounds["lo"] or 0.0, bounds["hi"] or 0.0
    t = (F.col("weight") - lo) / (hi - lo) if hi > lo else F.lit(0.0)
    return graph.edges.select("seq", (low + t * (high - low)).alias("thickness"))


def edge_thickness_by_weight(graph: Graph, min_thickness: float = 1.0, max_thickness: float = 5.0) -> Graph:
    return graph.with_(preview=graph.preview | {"edge.thickness": float(min_thickness), "edge.rescale-weight": True, "edge.rescale-weight.min": float(min_thickness), "edge.rescale-weight.max": float(max_thickness)})


def color_edges_by_endpoint(graph: Graph, end: str = "source") -> Graph:
    """Edges take the colour of their source or target."""
    ends = graph.nodes.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in "rgba"])
    joined = graph.edges.join(ends, F.col(end) == F.col("__id"), "left")
    return graph.with_(edges=joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in ("r", "g", "b", "a") else F.col(f"`{c}`") for c in graph.edges.columns]))


def set_node_color(graph: Graph, id: str, r: int = 0, g: int = 0, b: int = 0, a: int = 255) -> Graph:
    check_colour(r, g, b, a)
    return update_node(graph, id, r=r, g=g, b=b, a=a)


def set_node_size(graph: Graph, id: str, size: float) -> Graph:
    return update_node(graph, id, size=float(size))


def set_edge_color(graph: Graph, source: str, target: str, r: int, g: int, b: int, a: int = 255) -> Graph:
    check_colour(r, g, b, a)
    return update_edge(graph, source, target, r=r, g=g, b=b, a=a)


def reset_appearance(graph: Graph, r: int = 153, g: int = 153, b: int = 153, size: float = 10.0) -> Graph:
    check_colour(r, g, b)
    return graph.with_(nodes=graph.nodes.withColumns({"r": F.lit(r), "g": F.lit(g), "b": F.lit(b), "a": F.lit(255), "size": F.lit(float(size)).cast("float")}))
