"""Connected components (direction ignored), numbered by their first node; strong components of directed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph, Rounds, durable, flow, with_seq


def component_labels(pairs: DataFrame) -> DataFrame:
    """(node, label): the least node connected by the (a, b) rows, by alternating large and small stars (Kiveris et al. 2014).

    Each step is a minimum by node, combined before the shuffle, and a join that can be split at hubs.
    """
    now, before = durable(pairs.where("a <> b").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        now = durable(small.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    labels = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def connected_components(graph: Graph) -> Graph:
    """Nodes with ``componentnumber`` 0, 1, … in the order of each component's first node."""
    seqs = graph.nodes.select(F.col("id").alias("__id"), F.col("seq").alias("__seq"))
    e = graph.edges.select("source", "target").join(seqs.toDF("source", "a"), "source").join(seqs.toDF("target", "b"), "target")
    labels = component_labels(e.select("a", "b")).toDF("__node", "__label")
    labelled = durable(graph.nodes.drop("componentnumber").join(labels, F.col("seq") == F.col("__node"), "left").withColumn("__first", F.coalesce("__label", "seq")).drop("__node", "__label"))
    numbers = with_seq(labelled.select("__first").distinct(), "__first").select("__first", F.col("seq").cast("int").alias("componentnumber"))
    return graph.with_(nodes=labelled.join(numbers, "__first").drop("__first"))


def _spread(links: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (id, v) where each node has the greatest v of all nodes that links (s, t) lead to it from; a round passes on only what has changed."""
    rounds, now = Rounds(), state.withColumn("changed", F.lit(True))
    while True:
        sent = now.where("changed").join(links, F.col("id") == F.col("s")).groupBy(F.col("t").alias("id")).agg(F.max("v").alias("got"))
        new = now.select("id", "v").join(sent, "id", "left").select("id", F.greatest("v", "got").alias("v"), F.coalesce(F.col("got") > F.col("v"), F.lit(False)).alias("changed"))
        seen = Observation()
        now = rounds.write(new.observe(seen, F.count(F.when(F.col("changed"), 1)).alias("n")))
        if not seen.get["n"]:
            return now.select("id", "v")


def _trimmed(links: DataFrame) -> DataFrame:
    """Links without those at nodes that nothing leads to, or from: such nodes are on no cycle.  Repeated while that takes a tenth of the links away."""
    left = links.count()
    while left:
        before, rounds = left, Rounds()
        links = rounds.write(links.join(links.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(links.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"))
        left = links.count()
        if left > 0.9 * before:
            break
    return links


def strong_components(graph: Graph) -> DataFrame:
    """(id, component): the least node among those that can be reached from each node and lead back to it; undirected edges lead both ways.

    Forward-backward colouring (Orzan 2004) after trimming: each node takes the greatest name that reaches it as its colour; the nodes of a colour that reach the
    node of that name are a strong component.  All colours are worked on at once; what is left goes on to the next round.
    """
    links, found = durable(flow(graph).where("s <> t").distinct()), []
    while True:
        links = _trimmed(links)
        if links.isEmpty():
            break
        ids = links.select(F.explode(F.array("s", "t")).alias("id")).distinct()
        colours = durable(_spread(links, ids.withColumn("v", F.col("id"))).select("id", F.col("v").alias("colour")))
        ends = links.join(colours.toDF("s", "cs"), "s").join(colours.toDF("t", "ct"), "t").where("cs = ct")
        back = durable(ends.select(F.col("t").alias("s"), F.col("s").alias("t")))
        reached = _spread(back, colours.select("id", (F.col("id") == F.col("colour")).cast("int").alias("v"))).where("v = 1")
        strong = durable(colours.join(reached.select("id"), "id"))
        found.append(strong)
        gone = strong.select("id")
        links = durable(links.join(gone.toDF("s"), "s", "left_anti").join(gone.toDF("t"), "t", "left_anti").select("s", "t"))
    out = graph.nodes.select("id")
    if not found:
        return out.select("id", F.col("id").alias("component"))
    members = found[0]
    for f in found[1:]:
        members = members.unionByName(f)  # a colour is the name of a node of its component, so rounds never share one
    least = members.groupBy("colour").agg(F.min("id").alias("component"))
    return out.join(members.join(least, "colour").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
