"""Composite analyses: top lists, roles, communities and checks of the network's kind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, degrees, durable, undirected, with_seq
from ..operators import statistics as S
from ..operators.components import connected_components
from ..operators.paths import sketched_distances
from ..operators.query import graph_stats
from ..operators.rewiring import random_like


def top_k(values: DataFrame, metrics: list[str], k: int = 10, order: str = "id") -> DataFrame:
    """(metric, rank, id, value): the k greatest of each metric, ties by ``order``.

    Each metric is its own limited sort, so no task sorts all nodes.
    """
    lists = [values.select(F.lit(m).alias("metric"), "id", F.col(m).cast("double").alias("value"), F.col(order).alias("__o")).orderBy(F.desc("value"), "__o").limit(k) for m in metrics]
    both = lists[0]
    for x in lists[1:]:
        both = both.unionByName(x)
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "__o")
    return both.withColumn("rank", F.row_number().over(w)).select("metric", "rank", "id", "value")


def top_overlap(values: DataFrame, metrics: list[str], k: int = 10, least: int = 2, order: str = "id") -> DataFrame:
    """(id, lists): nodes in at least ``least`` of the top lists."""
    return top_k(values, metrics, k, order).groupBy("id").agg(F.count("*").alias("lists")).where(F.col("lists") >= least)


def percentile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact value at a share of the sorted column, between neighbours by their distance; sorted by range, so no task holds all values."""
    placed = with_seq(values.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), "v")
    n = placed.count()
    at = (n - 1) * share
    low, high = math.floor(at), math.ceil(at)
    got = {r["seq"]: r["v"] for r in placed.where(F.col("seq").isin(low, high)).collect()}  # two rows
    return got[low] + (got[high] - got[low]) * (at - low) if n else None


def roles(values: DataFrame, betweenness: str = "betweenesscentrality", degree: str = "degree", share: float = 0.5) -> DataFrame:
    """(id, role): by whether betweenness and degree are over their medians (or another share)."""
    values = durable(values.select("id", betweenness, degree))
    b, d = percentile(values, betweenness, share), percentile(values, degree, share)
    high_b, high_d = F.col(betweenness) > F.lit(b), F.col(degree) > F.lit(d)
    return values.select("id", F.when(high_b & high_d, "critical hub").when(high_b, "bridge").when(high_d, "local hub").otherwise("peripheral").alias("role"))


def quality_band(score):
    return F.when(score < 0.3, "weak").when(score < 0.5, "moderate").when(score <= 0.7, "strong").otherwise("very strong")


def community_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community").agg(F.count("*").alias("size"))


def community_links(graph: Graph, membership: DataFrame) -> DataFrame:
    """(from_community, to_community, edges, weight)."""
    m = membership.select("id", "community")
    e = graph.edges.select("source", "target", "weight").join(m.toDF("source", "from_community"), "source").join(m.toDF("target", "to_community"), "target")
    return e.groupBy("from_community", "to_community").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def community_profile(graph: Graph, membership: DataFrame) -> DataFrame:
    """(community, size, internal_edges, internal_density, bridges, key_member)."""
    sizes = community_sizes(membership)
    links = community_links(graph, membership)
    inside = links.where("from_community = to_community").select(F.col("from_community").alias("community"), F.col("edges").alias("internal_edges"))
    out = links.where("from_community <> to_community")
    bridges = out.select(F.col("from_community").alias("community"), "edges").unionByName(out.select(F.col("to_community").alias("community"), "edges")).groupBy("community").agg(F.sum("edges").alias("bridges"))
    key = membership.join(degrees(graph), "id").groupBy("community").agg(F.max_by("id", F.struct("degree", "id")).alias("key_member"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    n = F.col("size").cast("double")
    joined = sizes.join(inside, "community", "left").join(bridges, "community", "left").join(key, "community", "left")
    return joined.select("community", "size", zero("internal_edges"), F.when(n > 1, 2 * F.coalesce("internal_edges", F.lit(0)) / (n * (n - 1))).otherwise(0.0).alias("internal_density"), zero("bridges"), "key_member")


def small_world(graph: Graph, average_path_length: float | None = None) -> DataFrame:
    """Clustering (and, where known, path length) against a random graph of the same size: C = k/N, L = ln N / ln k."""
    stats = graph_stats(graph).select("node_count", "average_degree")
    c = S.clustering(graph).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("clustering"))
    n, k = F.col("node_count").cast("double"), F.col("average_degree")
    random_c = F.when(n > 0, k / n).otherwise(0.0)
    random_l = F.when((k > 1) & (n > 1), F.ln(n) / F.ln(k))
    out = c.join(stats).select("clustering", random_c.alias("random_clustering"), F.when(random_c > 0, F.col("clustering") / random_c).alias("clustering_ratio"), random_l.alias("random_path_length"))
    return out if average_path_length is None else out.withColumn("path_ratio", F.lit(average_path_length) / F.col("random_path_length"))


def degree_histogram(graph: Graph) -> DataFrame:
    return degrees(graph).groupBy("degree").agg(F.count("*").alias("nodes"))


def scale_free(graph: Graph) -> DataFrame:
    """Slope and fit of the log-log degree histogram."""
    h = degree_histogram(graph).where("degree > 0").select(F.ln("degree").alias("x"), F.ln("nodes").alias("y"))
    return h.agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("points"))


def power_law(graph: Graph) -> DataFrame:
    """(exponent, cut_off, distance, tail_nodes, points, likelihood_ratio, vuong): a power law fitted to the degrees from the best cut-off on; no row without links.

    For each cut-off the exponent is the likeliest one, 1 + n / sum(ln(x / (cut_off - 1/2))), and its distance the greatest difference of the distributions (Kolmogorov-Smirnov); the
    cut-off of the smallest distance is taken (Clauset, Shalizi & Newman 2009), the smaller one of equals.  Cut-offs need two different degrees or more above them.
    ``likelihood_ratio`` is against the likeliest exponential tail: positive where the power law explains the degrees better; ``vuong`` is the
    normalised ratio, which means something beyond 2 or below -2.

    A histogram has at most 2 sqrt(edges) different degrees, so it may be broadcast, and pairs of a cut-off and a degree are at most four times the edges.
    """
    above = Window.orderBy(F.col("degree").desc())  # a row for each degree, not for each node
    x, c, n = F.col("x").cast("double"), F.col("nodes"), F.col("n").cast("double")
    h = durable(degree_histogram(graph).where("degree > 0").withColumn("x", F.col("degree")))
    tails = h.withColumns({"n": F.sum("nodes").over(above), "logs": F.sum(c * F.ln(x)).over(above), "mean": F.sum(c * x).over(above), "rank": F.row_number().over(above)})
    tails = durable(tails.select("x", "nodes", "n", "logs", "mean", "rank"))
    low = F.col("cut_off") - 0.5
    cuts = tails.where("rank > 1").select(F.col("x").alias("cut_off"), F.col("n").alias("tail_nodes"), F.col("rank").alias("points"), "logs", "mean")
    cuts = cuts.withColumn("exponent", 1 + F.col("tail_nodes") / (F.col("logs") - F.col("tail_nodes") * F.ln(low))).repartition("cut_off")
    # Shares of the tail at x and above, and above x: the steps of the distribution on both sides.
    model = F.pow((F.col("x") - 0.5) / low, 1 - F.col("exponent"))
    beyond = F.pow((F.col("x") + 0.5) / low, 1 - F.col("exponent"))
    gap = F.greatest(F.abs(n / F.col("tail_nodes") - model), F.abs((n - c) / F.col("tail_nodes") - beyond))
    fits = cuts.join(F.broadcast(tails.select("x", "nodes", "n")), F.col("x") >= F.col("cut_off")).groupBy("cut_off", "exponent", "tail_nodes", "points", "logs", "mean").agg(F.max(gap).alias("distance"))
    best = durable(fits.orderBy(F.round("distance", 12), "cut_off").limit(1))
    rate = F.col("tail_nodes") / (F.col("mean") - F.col("tail_nodes") * low)
    gain = F.ln((F.col("exponent") - 1) / low) - F.col("exponent") * F.ln(x / low) - F.ln(F.col("rate")) + F.col("rate") * (x - low)
    tail = best.withColumn("rate", rate).join(h.select("x", "nodes"), F.col("x") >= F.col("cut_off")).withColumn("gain", gain)
    told = tail.groupBy("exponent", "cut_off", "distance", "tail_nodes", "points").agg(F.sum(c * F.col("gain")).alias("likelihood_ratio"), F.sum(c * F.col("gain") * F.col("gain")).alias("squares"))
    total, ratio = F.col("tail_nodes").cast("double"), F.col("likelihood_ratio")
    return told.withColumn("vuong", ratio / F.sqrt(F.col("squares") - ratio * ratio / total)).drop("squares")


def small_world_sample(graph: Graph, rounds: int = 10, seed: int = 0) -> dict:
    """Clustering and path length beside those of a random graph with the same degrees that is made, not assumed: ``small_world`` knows only closed forms.

    ``sigma`` is the ratio of the ratios (Humphries & Gurney 2008): far above 1 in small worlds.  Path lengths are sketched; ``changed`` is the share of edges that were moved.
    """
    links = undirected(graph).where("s < t")
    random = random_like(graph, rounds, seed).checkpoint()
    of = lambda g: (S.clustering(g).agg(F.coalesce(F.avg("clustering"), F.lit(0.0))).first()[0], sketched_distances(g)[1]["average_path_length"])
    (c, l), (rc, rl) = of(graph), of(random)
    edges = random.edges.count()
    same = random.edges.select(F.col("source").alias("s"), F.col("target").alias("t")).join(links, ["s", "t"], "left_semi").count()
    sigma = (c / rc) / (l / rl) if rc and l and rl else None
    return {"clustering": c, "random_clustering": rc, "path_length": l, "random_path_length": rl, "sigma": sigma, "changed": 1 - same / edges if edges else 0.0}


def structural_report(graph: Graph, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A one-row summary, and the top five by degree, betweenness and PageRank."""
    g, _ = S.compute_degree(graph)
    g, comp = S.compute_connected_components(g)
    g, mod = S.compute_modularity(g)
    g, paths = S.compute_betweenness(g, sample=sample)
    g, _ = S.compute_pagerank(g)
    g, clus = S.compute_clustering_coefficient(g)
    g = g.checkpoint()
    spread = g.nodes.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    summary = graph_stats(g).join(spread)
    for name, value in (comp | mod | paths | clus).items():
        summary = summary.withColumn(name, F.lit(value))
    summary = summary.withColumn("community_quality", quality_band(F.col("modularity")))
    return summary, top_k(g.nodes, ["degree", "betweenesscentrality", "pageranks"], 5, "seq")


def centrality_report(graph: Graph, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Top lists by degree, betweenness, PageRank and eigenvector centrality, and the nodes in several of them."""
    g, _ = S.compute_degree(graph)
    g, _ = S.compute_betweenness(g)
    g, _ = S.compute_pagerank(g)
    g, _ = S.compute_eigenvector(g)
    g = g.checkpoint()
    metrics = ["degree", "betweenesscentrality", "pageranks", "eigencentrality"]
    return top_k(g.nodes, metrics, k, "seq"), top_overlap(g.nodes, metrics, k, 2, "seq")


def component_sizes(graph: Graph) -> DataFrame:
    return connected_components(graph).nodes.groupBy("componentnumber").agg(F.count("*").alias("size"))
