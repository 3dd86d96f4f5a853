"""Communities: modularity, and its rise by independent moves with connected communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, Rounds, durable, with_seq
from .components import component_labels


def modularity_score(graph: Graph, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with ``modularity``: sum over communities of L_c/m - resolution (k_c/2m)^2, unweighted; membership is (id, community)."""
    m = membership.select(F.col("id").alias("__id"), F.col("community").alias("c"))
    e = graph.edges.select("source", "target").join(m.toDF("source", "cs"), "source").join(m.toDF("target", "ct"), "target")
    ends = e.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), F.when(F.col("cs") == F.col("ct"), 1).otherwise(0).alias("l")), F.struct(F.col("ct").alias("c"), F.lit(0).alias("l")))).alias("x")).select("x.c", "x.l")
    per = ends.groupBy("c").agg(F.sum("l").cast("double").alias("l"), F.count("*").cast("double").alias("k"))
    total = per.agg(F.sum("l").alias("inside"), F.sum("k").alias("k2"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    return total.select(F.when(F.col("k2") > 0, 2 * F.col("inside") / F.col("k2") - resolution * F.col("squares") / (F.col("k2") * F.col("k2"))).otherwise(0.0).alias("modularity"))


def _quality(links: DataFrame, member: DataFrame, total: float, resolution: float) -> float:
    """The modularity of ``member`` (id, c) on links (s, t, w) that lead both ways and weigh ``total``."""
    here, there = member.toDF("s", "cs"), member.toDF("t", "ct")
    ends = links.join(here, "s").join(there, "t")
    per = ends.groupBy("cs").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w"))).alias("inside"))
    inside, squares = per.agg(F.coalesce(F.sum("inside"), F.lit(0.0)), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))).first()
    return inside / total - resolution * squares / (total * total)


def _wishes(links: DataFrame, now: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, k, c, to, gain): nodes of ``now`` (id, k, c) for which a neighbouring community is better than their own, and the best of those."""
    near = links.where("s <> t").join(now.select(F.col("id").alias("t"), F.col("c").alias("to")), "t").select("s", "to", "w")
    near = near.unionByName(now.select(F.col("id").alias("s"), F.col("c").alias("to"), F.lit(0.0).alias("w"))).groupBy("s", "to").agg(F.sum("w").alias("w"))
    sizes = now.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("kc"))
    options = near.join(now.withColumnRenamed("id", "s"), "s").join(sizes, "to")
    home = F.col("to") == F.col("c")
    value = F.col("w") - resolution * F.col("k") * (F.col("kc") - F.when(home, F.col("k")).otherwise(0.0)) / total  # of being in a community beside the others
    best = options.withColumn("value", value).groupBy("s").agg(
        F.first("k").alias("k"), F.first("c").alias("c"), F.max(F.when(home, F.col("value"))).alias("stay"), F.min(F.when(~home, F.struct((-F.col("value")).alias("v"), "to"))).alias("go")
    )
    return best.select(F.col("s").alias("id"), "k", "c", F.col("go.to").alias("to"), (-F.col("go.v") - F.col("stay")).alias("gain")).where("gain > 1e-9")


def _made(links: DataFrame, wishes: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, to, gain) of the wishes that gain even if all wishes of higher rank come true as well.

    What two moves take from each other: the weight between their nodes, where one enters the community that the other leaves (twice, if they swap), and the
    product of their degrees, where they enter or leave the same community.  Each loss is charged to the wish that gains less.  So the moves of
    a round are independent: they may all be made, and modularity rises by what is left of their gains at least.
    """
    rank = F.struct(F.col("gain"), F.xxhash64("id"), F.col("id"))
    ranked = wishes.withColumn("rank", rank)
    mine, other = ranked.select(F.col("id").alias("s"), "c", "to", "rank"), ranked.select(F.col("id").alias("t"), F.col("c").alias("tc"), F.col("to").alias("tto"), F.col("rank").alias("trank"))
    pairs = links.where("s <> t").join(mine, "s").join(other, "t").where("trank > rank AND (tc = to OR tto = c)")
    crossed = (F.col("tc") == F.col("to")).cast("double") + (F.col("tto") == F.col("c")).cast("double")
    followed = pairs.groupBy(F.col("s").alias("id")).agg(F.sum(F.col("w") * crossed).alias("lost"))
    before = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    crowd = ranked.withColumn("entering", before("to")).withColumn("leaving", before("c"))
    left = F.col("gain") - F.coalesce("lost", F.lit(0.0)) - resolution * F.col("k") * (F.col("entering") + F.col("leaving")) / total
    return crowd.join(followed, "id", "left").select("id", "to", left.alias("gain")).where("gain > 1e-9")


def _move(links: DataFrame, now: DataFrame, total: float, resolution: float, tolerance: float) -> tuple[DataFrame, bool]:
    """``now`` (id, k, c) after rounds of moves; whether any was made.

    They end when a round has none, or raises modularity by less than ``tolerance`` or a twentieth of what the rounds before have: the
    last moves come cheaper when all starts again.
    """
    wished, states, gained, moved = Rounds(), Rounds(), 0.0, False
    while True:
        seen = Observation()
        wishes = wished.write(_wishes(links, now, total, resolution).observe(seen, F.count("*").alias("n")))
        if not seen.get["n"]:
            return now, moved
        seen = Observation()
        made = now.join(_made(links, wishes, total, resolution), "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), "gain")
        now = states.write(made.observe(seen, F.sum("gain").alias("gain"))).drop("gain")
        gain, moved = 2 * seen.get["gain"] / total, True
        if gain < max(tolerance, gained / 20):
            return now, moved
        gained += gain


def _connected(links: DataFrame, member: DataFrame) -> DataFrame:
    """``member`` (id, c) with every community split into its connected parts, which never lowers modularity."""
    inside = links.where("s < t").join(member.toDF("s", "cs"), "s").join(member.toDF("t", "ct"), "t").where("cs = ct")
    labels = component_labels(inside.select(F.col("s").alias("a"), F.col("t").alias("b")))
    return durable(member.select("id").join(labels.toDF("id", "c"), "id", "left").select("id", F.coalesce("c", "id").alias("c")))


def louvain(graph: Graph, resolution: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """(id, community) by repeated moves and contraction (Blondel et al. 2008; resolution as Reichardt & Bornholdt 2006), communities connected (as Traag et al. 2019 ask).

    Each round makes many moves at once that cannot spoil each other (:func:`_made`); it needs no colouring of the graph, whose rounds would
    be as many as the largest degree.  Communities are contracted to nodes until none moves; from what is found all starts again on the nodes
    themselves, until that gains less than ``tolerance``.  At last communities are split into their connected parts.  The same at every size, never worse than single nodes.
    """
    e = graph.edges.select(F.col("source").alias("s"), F.col("target").alias("t"))
    links = durable(e.unionByName(e.select(F.col("t").alias("s"), F.col("s").alias("t"))).groupBy("s", "t").agg(F.count("*").cast("double").alias("w")))
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return durable(graph.nodes.select("id", F.col("id").alias("community")))
    degree = durable(links.groupBy(F.col("s").alias("id")).agg(F.sum("w").alias("k")))
    member, best = degree.select("id", F.col("id").alias("c")), None
    while True:
        now, moved = _move(links, degree.join(member, "id"), total, resolution, tolerance)
        found, level = now.select("id", "c"), links
        while moved:
            names = now.select(F.col("id").alias("s"), F.col("c").alias("cs"))
            level = durable(level.join(names, "s").join(names.toDF("t", "ct"), "t").groupBy(F.col("cs").alias("s"), F.col("ct").alias("t")).agg(F.sum("w").alias("w")))
            now, moved = _move(level, level.groupBy(F.col("s").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")), total, resolution, tolerance)
            if moved:
                found = durable(found.join(now.select(F.col("id").alias("c"), F.col("c").alias("next")), "c").select("id", F.col("next").alias("c")))
        score = _quality(links, found, total, resolution)
        if best is not None and score < best + tolerance:
            break
        member, best = found, score
    member = _connected(links, member if score < best else found)
    return durable(graph.nodes.select("id").join(member, "id", "left").select("id", F.coalesce("c", "id").alias("community")))


def compute_modularity(graph: Graph, resolution: float = 1.0) -> tuple[Graph, dict]:
    """modularity_class 0, 1, … by size, and the score."""
    if resolution <= 0:
        raise GraphError("resolution must be positive")
    member = durable(louvain(graph, resolution))
    sizes = member.groupBy("community").agg((-F.count("*")).alias("n"))
    numbers = with_seq(sizes, "n", "community").select("community", F.col("seq").cast("int").alias("modularity_class"))
    nodes = graph.nodes.drop("modularity_class").join(member.join(numbers, "community").select("id", "modularity_class"), "id", "left")
    return graph.with_(nodes=nodes), {"modularity": modularity_score(graph, member, resolution).first()[0], "communities": sizes.count()}
