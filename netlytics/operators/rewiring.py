"""Random graphs with the degrees of a given one, by swaps of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, Rounds, edge_frame, undirected, with_seq

BIN_EDGES = 1000  # edges that are paired among themselves in a round


def rewired(graph: Graph, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(s, t), s < t: the simple undirected graph's edges after double edge swaps, in which every node keeps its degree.

    A round deals the edges by hash into bins of about ``BIN_EDGES`` and pairs those that follow each other there, so an edge is in one pair at most.  A pair
    (a, b), (c, d) becomes (a, d), (c, b), or (a, c), (b, d), where that makes no loop, no edge that there is, and none that another pair of the round with a
    smaller number makes, too.  Pairs without success keep their edges.  Ten rounds try every edge ten times.  Loops and repeated edges of the graph are left out.
    Hashes of the edges and the round choose everything: a lost task gives the same again, and the same seed the same graph.
    """
    kept = Rounds()
    edges = kept.write(undirected(graph).where("s < t"))
    bins = max(1, edges.count() // BIN_EDGES)
    for i in range(rounds):
        hashed = edges.withColumn("h", F.xxhash64("s", "t", F.lit(seed), F.lit(i)))
        placed = hashed.withColumn("bin", F.pmod("h", F.lit(bins))).withColumn("at", F.row_number().over(Window.partitionBy("bin").orderBy("h", "s", "t")) - 1)
        # Places in a bin go to 2**31, so the number of a pair is unique.
        paired = kept.write(placed.select("s", "t", (F.col("bin") * F.lit(1 << 31) + F.floor(F.col("at") / 2)).alias("pair"), (F.col("at") % 2).alias("at"), F.pmod(F.shiftright("h", 7), F.lit(2)).alias("turn")))
        first, second = (paired.where(F.col("at") == k) for k in (0, 1))
        both = first.select("pair", F.col("s").alias("a"), F.col("t").alias("b"), "turn").join(second.select("pair", F.col("s").alias("c"), F.col("t").alias("d")), "pair")
        made = both.select("pair", F.explode(F.when(F.col("turn") == 0, F.array(F.struct(F.col("a").alias("x"), F.col("d").alias("y")), F.struct(F.col("c").alias("x"), F.col("b").alias("y")))).otherwise(F.array(F.struct(F.col("a").alias("x"), F.col("c").alias("y")), F.struct(F.col("b").alias("x"), F.col("d").alias("y"))))).alias("e"))
        made = made.select("pair", "e.x", "e.y").where("x <> y").select("pair", F.least("x", "y").alias("s"), F.greatest("x", "y").alias("t"))
        # Of all that want an edge the smallest number wins; edges that there are have -1.
        won = made.unionByName(paired.select(F.lit(-1).cast("long").alias("pair"), "s", "t")).groupBy("s", "t").agg(F.min("pair").alias("pair")).where("pair >= 0")
        won = kept.write(won.select("pair", "s", "t"))
        done = won.groupBy("pair").agg(F.count("*").alias("n")).where("n = 2").select("pair")
        edges = kept.write(paired.join(done, "pair", "left_anti").select("s", "t").unionByName(won.join(done, "pair").select("s", "t")))
    return edges


def random_like(graph: Graph, rounds: int = 10, seed: int = 0) -> Graph:
    """An undirected random graph with the nodes and degrees of ``graph``, its loops and repeated edges left out."""
    edges = with_seq(rewired(graph, rounds, seed).toDF("source", "target"), "source", "target").withColumn("directed", F.lit(False))
    return graph.with_(edges=edge_frame(edges))
