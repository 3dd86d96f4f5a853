"""Betweenness from sampled pairs of nodes, to an error that holds with a stated probability."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, Rounds, durable, flow, undirected, with_seq


def _pairs(numbered: DataFrame, n: int, first: int, count: int, seed: int) -> DataFrame:
    """(p, s, t): ordered pairs of different nodes, each as likely, by hashes of the pair's number: a task that is run again draws the same."""
    draw = lambda what, bound: F.pmod(F.xxhash64("p", F.lit(seed), F.lit(what)), F.lit(bound))
    p = numbered.sparkSession.range(first, first + count).withColumnRenamed("id", "p").withColumns({"i": draw("s", n), "j": draw("t", n - 1)})
    p = p.withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("long"))
    return p.join(numbered.toDF("s", "i"), "i").join(numbered.toDF("t", "j"), "j").select("p", "s", "t")


def _searches(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p, v, d0, w0, d1, w1): what the searches of each pair found from its first (0) and second node (1): distances and numbers of shortest paths.

    All pairs are searched side by side.  In a round a pair's smaller frontier goes one step, until the two sides meet or one can go no further.
    The nodes that both sides found are then those in the middle of all shortest paths.
    """
    none, no = F.lit(None).cast("int"), F.lit(None).cast("double")
    first = pairs.select("p", F.col("s").alias("v"), F.lit(0).alias("d0"), F.lit(1.0).alias("w0"), none.alias("d1"), no.alias("w1"), F.lit(True).alias("f0"), F.lit(False).alias("f1"))
    second = pairs.select("p", F.col("t").alias("v"), none.alias("d0"), no.alias("w0"), F.lit(0).alias("d1"), F.lit(1.0).alias("w1"), F.lit(False).alias("f0"), F.lit(True).alias("f1"))
    rounds, turns = Rounds(), Rounds()
    found = rounds.write(first.unionByName(second))
    size = lambda f: F.count(F.when(F.col(f), 1))
    while True:
        now = found.groupBy("p").agg(size("f0").alias("n0"), size("f1").alias("n1"), F.count(F.when(F.col("d0").isNotNull() & F.col("d1").isNotNull(), 1)).alias("met"))
        turn = turns.write(now.where("met = 0 AND n0 > 0 AND n1 > 0").select("p", F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("side")))
        if turn.isEmpty():
            return found.select("p", "v", "d0", "w0", "d1", "w1")
        known = found.join(turn, "p", "left").withColumns({"sd": none, "sw": no})
        ahead = known.where("(side = 0 AND f0) OR (side = 1 AND f1)").select("p", "side", F.col("v").alias("s"), (F.when(F.col("side") == 0, F.col("d0")).otherwise(F.col("d1")) + 1).alias("sd"), F.when(F.col("side") == 0, F.col("w0")).otherwise(F.col("w1")).alias("sw"))
        step = ahead.join(links, ["side", "s"]).groupBy("p", "side", F.col("t").alias("v")).agg(F.max("sd").alias("sd"), F.sum("sw").alias("sw"))
        # One aggregation brings together what was known and the step; a node keeps the first distance a side has found.
        both = known.unionByName(step, allowMissingColumns=True).groupBy("p", "v").agg(*[F.max(c).alias(c) for c in ("side", "d0", "w0", "d1", "w1", "f0", "f1", "sd", "sw")])
        moved = {}
        for k in (0, 1):
            turned = F.coalesce(F.col("side") == k, F.lit(False))
            moved |= {f"d{k}": F.when(turned, F.coalesce(f"d{k}", "sd")).otherwise(F.col(f"d{k}")), f"w{k}": F.when(turned, F.coalesce(f"w{k}", "sw")).otherwise(F.col(f"w{k}"))}
            moved[f"f{k}"] = F.when(turned, F.col(f"d{k}").isNull() & F.col("sd").isNotNull()).otherwise(F.coalesce(f"f{k}", F.lit(False)))
        found = rounds.write(both.select("p", "v", *[c.alias(k) for k, c in moved.items()]).select("p", "v", "d0", "w0", "d1", "w1", "f0", "f1"))


def _shares(links: DataFrame, found: DataFrame) -> DataFrame:
    """(v, q): the share of each pair's shortest paths that go through v, its ends left out; from the middle back to both ends, a layer a round."""
    met = found.where("d0 IS NOT NULL AND d1 IS NOT NULL")
    total = met.groupBy("p").agg(F.sum(F.col("w0") * F.col("w1")).alias("all"))
    met = durable(met.join(total, "p").withColumn("q", F.col("w0") * F.col("w1") / F.col("all")))
    parts = [met.where("d0 > 0 AND d1 > 0").select("v", "q")]
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"d{k}").alias("d"), (F.col("q") / F.col(f"w{k}")).alias("c")) for k in (0, 1)]))
    at = met.select("p", "v", sides.alias("x")).select("p", "v", "x.side", "x.d", "x.c")
    while True:
        step = at.where("d > 1").select("p", F.col("v").alias("s"), F.col("side").alias("to"), (1 - F.col("side")).alias("side"), (F.col("d") - 1).alias("d"), "c")
        step = step.join(links, ["side", "s"]).groupBy("p", F.col("to").alias("side"), F.col("t").alias("v"), "d").agg(F.sum("c").alias("c"))
        mine = lambda what: F.when(F.col("side") == 0, F.col(f"{what}0")).otherwise(F.col(f"{what}1"))
        at = durable(step.join(found, ["p", "v"]).where(mine("d") == F.col("d")).select("p", "v", "side", "d", "c", (F.col("c") * mine("w")).alias("q")))
        if at.isEmpty():
            break
        parts.append(at.select("v", "q"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sampled_betweenness(graph: Graph, error: float = 0.01, probability: float = 0.9, directed: bool = False, seed: int = 0) -> tuple[DataFrame, dict]:
    """(id, betweenesscentrality, error): normalised betweenness of all nodes, and how far each may be off; with ``probability`` none is off by more.

    A sample is a pair of nodes and what share of its shortest paths each node lies on (Riondato & Upfal 2018, "ABRA"), so its mean is
    the betweenness.  Searches go out from both ends.  The number of pairs is doubled until the empirical Bernstein bound (Maurer & Pontil 2009) of every node is
    within ``error``, or until Hoeffding's inequality says so without looking; what is allowed to fail is dealt out to all nodes and all looks.
    No row is larger than a node of one search, and no task holds a graph.  Pairs without a path count as such; graphs of less than three nodes have only zeros.
    """
    if not (0 < error < 1 and 0 < probability < 1):
        raise GraphError("error and probability must lie between 0 and 1")
    nodes = graph.nodes.select("id")
    n = nodes.count()
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenesscentrality"), F.lit(0.0).alias("error")), {"pairs": 0, "looks": 0, "error": 0.0}
    scale = n / (n - 2)  # from the share of all ordered pairs to that of pairs of other nodes
    within, fail = error / scale, (1 - probability) / 2
    most = math.ceil(math.log(2 * n / fail) / (2 * within**2))
    numbered = durable(with_seq(nodes, "id").select("id", "seq"))
    out = durable(flow(graph).where("s <> t").distinct() if directed else undirected(graph))
    links = durable(out.select(F.lit(0).alias("side"), "s", "t").unionByName(out.select(F.lit(1).alias("side"), F.col("t").alias("s"), F.col("s").alias("t"))))
    r, looks, sums = 0, 0, None
    wanted = min(most, math.ceil(7 * math.log(8 * n / fail) / (3 * within)) + 2)
    while True:
        looks += 1
        fresh = _shares(links, _searches(links, durable(_pairs(numbered, n, r, wanted - r, seed)))).groupBy("v").agg(F.sum("q").alias("q1"), F.sum(F.col("q") * F.col("q")).alias("q2"))
        sums = durable(fresh if sums is None else sums.unionByName(fresh).groupBy("v").agg(F.sum("q1").alias("q1"), F.sum("q2").alias("q2")))
        r = wanted
        log = math.log(4 * n * 2**looks / fail)
        spread = F.greatest(F.lit(0.0), F.col("q2") - F.col("q1") * F.col("q1") / r) / (r - 1)
        off = F.sqrt(2 * spread * log / r) + 7 * log / (3 * (r - 1))
        worst = sums.agg(F.coalesce(F.max(off), F.lit(0.0))).first()[0]
        if max(worst, 7 * log / (3 * (r - 1))) <= within or r >= most:
            break
        wanted = min(most, 2 * r)
    half = F.least(off, F.lit(within)) if r >= most else off
    unseen = min(within, 7 * log / (3 * (r - 1)))
    values = sums.select(F.col("v").alias("id"), (F.col("q1") / r * scale).alias("b"), (half * scale).alias("e"))
    out = nodes.join(values, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenesscentrality"), F.coalesce("e", F.lit(unseen * scale)).alias("error"))
    return out, {"pairs": r, "looks": looks, "error": error}
