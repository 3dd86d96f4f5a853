"""The property graph: two DataFrames with built-in columns and any attributes, never changed in place."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_BUILTIN = ("id", "seq", "label", "x", "y", "size", "r", "g", "b", "a")
EDGE_BUILTIN = ("seq", "source", "target", "type", "directed", "weight", "label", "r", "g", "b", "a")
NODE_SCHEMA = "id string, seq long, label string, x float, y float, size float, r int, g int, b int, a int"
EDGE_SCHEMA = "seq long, source string, target string, type int, directed boolean, weight double, label string, r int, g int, b int, a int"


class GraphError(ValueError):
    """A request the graph cannot fulfil (unknown node, existing id, wrong type, ...)."""


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise GraphError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="netlytics-checkpoints-")  # tests on one machine
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        context.setCheckpointDir(path)
    return f"{context.getCheckpointDir()}/netlytics/{context.applicationId}"


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``)."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables of :func:`durable` of this application: graphs that were made from them cannot be read any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the folder all executors share (``spark.checkpoint.dir``) and read back; :func:`clean` deletes all of them.

    Not ``checkpoint()``: that keeps what the optimizer has inferred about the columns, which over the
    rounds of a loop doubles each time.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop: each is made from the last one, so the one before that is deleted."""

    def __init__(self):
        self._paths: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = shared_path(spark)
        df.write.parquet(path)
        self._paths.append(path)
        if len(self._paths) > 2:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._paths.pop(0))
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.schema(df.schema).parquet(path)


def start_position(id_col, axis: str):
    """A repeatable position in [-500, 500) from the id."""
    return (F.pmod(F.xxhash64(id_col, F.lit(axis)), F.lit(1_000_000)) / 1000.0 - 500.0).cast("float")


@dataclass(frozen=True)
class Graph:
    """Nodes, edges, rendering settings, and the graph this one was made from."""

    nodes: DataFrame
    edges: DataFrame
    preview: dict = field(default_factory=dict)
    parent: Graph | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **changes) -> Graph:
        return replace(self, parent=self, **changes)

    def undo(self) -> Graph:
        """The graph before the last change."""
        return self.parent or self

    def attributes(self, target: str = "node") -> list[str]:
        """The columns that are not built in."""
        df, builtin = (self.edges, EDGE_BUILTIN) if target == "edge" else (self.nodes, NODE_BUILTIN)
        return [c for c in df.columns if c not in builtin]

    def checkpoint(self) -> Graph:
        return replace(self, nodes=durable(self.nodes), edges=durable(self.edges))


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))


def _with_defaults(df: DataFrame, defaults: dict, builtin: tuple) -> DataFrame:
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    return df.select(*builtin, *[c for c in df.columns if c not in builtin])


def _grey() -> dict:
    return {c: F.lit(153) for c in "rgb"} | {"a": F.lit(255)}


def node_defaults() -> dict:
    """What a node has that says nothing but its id."""
    return {"label": F.col("id"), "x": start_position(F.col("id"), "x"), "y": start_position(F.col("id"), "y"), "size": F.lit(10.0).cast("float")} | _grey()


def edge_defaults() -> dict:
    return {"weight": F.lit(1.0)} | _grey()


def node_frame(df: DataFrame) -> DataFrame:
    """Any DataFrame with ``id`` (and ``seq``) as a node table with the default looks."""
    return _with_defaults(df, node_defaults(), NODE_BUILTIN)


def edge_frame(df: DataFrame) -> DataFrame:
    """Any DataFrame with ``source`` and ``target`` (and ``seq``) as an edge table."""
    directed = F.col("directed") if "directed" in df.columns else F.lit(True)
    defaults = {"directed": F.lit(True), "type": F.when(directed, 1).otherwise(0), "label": F.lit(None).cast("string")} | edge_defaults()
    return _with_defaults(df, defaults, EDGE_BUILTIN)


def with_seq(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ordinals ``seq`` by the given columns: sorted by range, numbered within tasks, and moved on by the tasks' counts (a row each)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % F.lit(1 << 33)))
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __start long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn("seq", F.col("__at") + F.col("__start")).drop("__part", "__at", "__start")


def from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
    """A graph from (source, target, …) rows; nodes are the ends unless given."""
    if nodes is None:
        ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).where("id IS NOT NULL").distinct()
        nodes = with_seq(ends, "id")
    if "seq" not in edges.columns:
        edges = with_seq(edges, "source", "target")
    return Graph(node_frame(nodes), edge_frame(edges))


def degrees(graph: Graph) -> DataFrame:
    """(id, indegree, outdegree, degree) of all nodes; a loop counts as two."""
    ends = graph.edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(graph.edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return graph.nodes.select("id").join(counts, "id", "left").select("id", zero("i").alias("indegree"), zero("o").alias("outdegree"), (zero("i") + zero("o")).alias("degree"))


def undirected(graph: Graph) -> DataFrame:
    """Distinct (s, t) neighbours in both directions, without loops."""
    e = graph.edges.where("source <> target")
    return e.select(F.col("source").alias("s"), F.col("target").alias("t")).unionByName(e.select(F.col("target").alias("s"), F.col("source").alias("t"))).distinct()


def flow(graph: Graph) -> DataFrame:
    """(s, t) for walks along edges: undirected ones lead both ways."""
    e = graph.edges
    return e.select(F.col("source").alias("s"), F.col("target").alias("t")).unionByName(e.where("NOT directed AND source <> target").select(F.col("target").alias("s"), F.col("source").alias("t")))


SPARK_TYPES = {"string": T.StringType(), "integer": T.IntegerType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType()}
