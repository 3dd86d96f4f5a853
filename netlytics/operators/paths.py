"""Distances without all pairs: closeness from sketches of neighbourhoods, diameter and radius from bounds of eccentricities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..graph import Graph, Rounds, durable, flow, undirected
from .components import component_labels


def sketched_distances(graph: Graph, directed: bool = False, precision: int = 12) -> tuple[DataFrame, dict]:
    """(id, closnesscentrality, harmonicclosnesscentrality, eccentricity, reached), estimated, and the average path length and diameter.

    Each node has a HyperLogLog sketch of the nodes within d steps; a round unites it with those of its neighbours (Boldi & Vigna 2013, "In-core
    computation of geometric centralities with HyperBall").  What a round adds is at distance d.  A node has one sketch of about 2**precision bytes at most,
    and rounds are as many as the diameter; counts err by about 0.8 / sqrt(2**precision), and are exact while small.
    """
    links = flow(graph).where("s <> t").distinct() if directed else undirected(graph)
    links = durable(links.groupBy("s").agg(F.collect_list("t").alias("ts")).select("s", F.explode("ts").alias("t")))
    state = durable(graph.nodes.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(precision)).alias("ball")).select(
        "id", "ball", F.lit(1).cast("long").alias("within"), F.lit(0.0).alias("far"), F.lit(0.0).alias("near"), F.lit(0).alias("ecc")
    ))
    rounds, d = Rounds(), 0
    while True:
        d += 1
        taken = links.join(state.select(F.col("id").alias("t"), "ball"), "t").select(F.col("s").alias("id"), "ball")
        balls = taken.unionByName(state.select("id", "ball")).groupBy("id").agg(F.hll_union_agg("ball").alias("ball"))
        both = state.drop("ball").join(balls, "id").withColumn("now", F.greatest("within", F.hll_sketch_estimate("ball")))
        more = (F.col("now") - F.col("within")).cast("double")
        new = both.select("id", "ball", F.col("now").alias("within"), (F.col("far") + d * more).alias("far"), (F.col("near") + more / d).alias("near"), F.when(more > 0, d).otherwise(F.col("ecc")).alias("ecc"), more.alias("more"))
        seen = Observation()
        state = rounds.write(new.observe(seen, F.sum("more").alias("more"))).drop("more")
        if not seen.get["more"]:
            break
    n = graph.nodes.count()
    reached = F.col("within") - 1
    out = state.select("id", F.when(F.col("far") > 0, reached / F.col("far")).otherwise(0.0).alias("closnesscentrality"), (F.col("near") / max(1, n - 1)).alias("harmonicclosnesscentrality"), F.col("ecc").cast("double").alias("eccentricity"), reached.alias("reached"))
    row = state.agg(F.sum("far"), F.sum(reached), F.max("ecc")).first()
    return out, {"average_path_length": row[0] / row[1] if row[1] else 0.0, "diameter": row[2] or 0}


def _searches(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(o, v, d): the distances from the nodes of ``sources`` (o), all searches a layer at a time."""
    found, rounds = durable(sources.select("o", F.col("o").alias("v"), F.lit(0).alias("d"))), Rounds()
    d = 0
    while True:
        d += 1
        seen = Observation()
        step = found.where(F.col("d") == d - 1).join(links, F.col("v") == F.col("s")).select("o", F.col("t").alias("v"), F.lit(d).alias("d"))
        # The nearest of all ways, found ones included: one aggregation instead of an anti-join.
        nearest = found.unionByName(step).groupBy("o", "v").agg(F.min("d").alias("d"))
        found = rounds.write(nearest.observe(seen, F.count(F.when(F.col("d") == d, 1)).alias("n")))
        if not seen.get["n"]:
            return found


def path_bounds(graph: Graph, batch: int = 16) -> dict:
    """The exact diameter and radius (among nodes that reach another) of the undirected graph, and how many searches they took.

    A search from v with eccentricity e bounds that of each w at distance d: max(d, e - d) <= ecc(w) <= e + d (Takes & Kosters 2011).  Each
    round searches from up to ``batch`` nodes of every component that can still change the answer: those with the greatest upper
    and the smallest lower bounds, by degree among equals.  Components are searched side by side; no node is in a round's table more than ``batch`` times.
    """
    links = durable(undirected(graph))
    labels = component_labels(links.select(F.col("s").alias("a"), F.col("t").alias("b")))
    nodes = links.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("degree")).join(labels.toDF("v", "part"), "v")
    bounds = durable(nodes.select("v", "part", "degree", F.lit(0).alias("low"), F.lit(1 << 30).alias("high")))
    searches, rounds = 0, Rounds()
    if bounds.isEmpty():
        return {"diameter": 0, "radius": 0, "searches": 0}
    while True:
        parts = bounds.groupBy("part").agg(F.max("low").alias("dlow"), F.max("high").alias("dhigh"), F.min("low").alias("rlow"), F.min("high").alias("rhigh"))
        diameter, radius = parts.agg(F.max("dlow"), F.min("rhigh")).first()  # found at least, found at most
        wanted = bounds.join(parts, "part").where((F.col("dhigh") > diameter) | (F.col("rlow") < radius)).where("low < high")
        top = F.row_number().over(Window.partitionBy("part").orderBy(F.col("high").desc(), F.col("degree").desc(), "v"))
        mid = F.row_number().over(Window.partitionBy("part").orderBy("low", F.col("degree").desc(), "v"))
        # Only nodes whose own bounds can matter: above the diameter found or below the radius found.
        chosen = wanted.where((F.col("high") > diameter) | (F.col("low") < radius)).withColumns({"top": top, "mid": mid}).where((F.col("top") <= batch // 2) | (F.col("mid") <= batch - batch // 2))
        chosen = durable(chosen.select(F.col("v").alias("o")))
        n = chosen.count()
        if not n:
            return {"diameter": diameter, "radius": radius, "searches": searches}
        searches += n
        found = _searches(links, chosen)
        ecc = found.groupBy("o").agg(F.max("d").alias("e"))
        told = found.join(ecc, "o").groupBy("v").agg(F.max(F.greatest(F.col("d"), F.col("e") - F.col("d"))).alias("l"), F.min(F.col("e") + F.col("d")).alias("h"))
        bounds = rounds.write(bounds.join(told, "v", "left").select("v", "part", "degree", F.greatest("low", F.coalesce("l", "low")).alias("low"), F.least("high", F.coalesce("h", "high")).alias("high")))
