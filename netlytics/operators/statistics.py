"""Graph statistics: each adds node columns and returns its scalars.

Definitions (directions, normalisation, rounds) follow the papers named at each function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, degrees, durable, flow, undirected
from .communities import compute_modularity, louvain, modularity_score
from .components import connected_components
from .sampling import sampled_betweenness

__all__ = ["compute_modularity", "louvain", "modularity_score"]

#: Adjacency is sent to all tasks only up to this many neighbour entries (8 bytes each); beyond it distances use joins.
MAX_SHARED_NEIGHBOURS = 20_000_000


def compute_degree(graph: Graph) -> tuple[Graph, dict]:
    """degree, indegree, outdegree; average_degree is 2E/N."""
    old = [c for c in ("degree", "indegree", "outdegree") if c in graph.nodes.columns]
    out = graph.with_(nodes=graph.nodes.drop(*old).join(degrees(graph), "id", "left"))
    return out, {"average_degree": degrees(graph).agg(F.coalesce(F.avg("degree"), F.lit(0.0))).first()[0]}


def compute_connected_components(graph: Graph) -> tuple[Graph, dict]:
    out = connected_components(graph)
    n = out.nodes.agg(F.max("componentnumber")).first()[0]
    return out, {"connected_components": 0 if n is None else n + 1}


def _add(graph: Graph, values: DataFrame, columns: list[str], fill=0.0) -> Graph:
    nodes = graph.nodes.drop(*columns).join(values.select("id", *columns), "id", "left")
    return graph.with_(nodes=nodes.withColumns({c: F.coalesce(c, F.lit(fill)) for c in columns}))


def pagerank(graph: Graph, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, pageranks) by power iteration with dangling mass spread evenly (Brin & Page 1998)."""
    links = flow(graph)
    out = links.groupBy("s").agg(F.count("*").alias("d"))
    links = durable(links.join(out, "s").select("s", "t", "d"))
    ids = durable(graph.nodes.select("id").join(out.select(F.col("s").alias("id"), "d"), "id", "left"))
    n, loose = ids.agg(F.count("*"), F.count_if(F.isnull("d"))).first()
    lost = loose / n if n else 0.0
    rank = ids.select("id", "d", F.lit(1.0 / n if n else 0.0).alias("r"))
    for _ in range(rounds if n else 0):
        given = links.join(rank.select(F.col("id").alias("s"), "r"), "s").groupBy("t").agg(F.sum(F.col("r") / F.col("d")).alias("x"))
        new = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("x", F.lit(0.0))
        moved = durable(rank.join(given, F.col("id") == F.col("t"), "left").select("id", "d", new.alias("r"), F.abs(new - F.col("r")).alias("delta")))
        rank = moved.drop("delta")
        delta, lost = moved.agg(F.sum("delta"), F.coalesce(F.sum(F.when(F.isnull("d"), F.col("r"))), F.lit(0.0))).first()
        if tolerance and delta < tolerance:
            break
    return rank.select("id", F.col("r").alias("pageranks"))


def compute_pagerank(graph: Graph, **options) -> tuple[Graph, dict]:
    return _add(graph, pagerank(graph, **options), ["pageranks"]), {}


def hits(graph: Graph, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """(id, Authority, Hub), normalised to length 1 in each round (Kleinberg 1999)."""
    links = durable(flow(graph))
    now = graph.nodes.select("id", F.lit(1.0).alias("h"), F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("a0"))
    for _ in range(rounds):
        a = links.join(now.select(F.col("id").alias("s"), "h"), "s").groupBy("t").agg(F.sum("h").alias("a"))
        h = links.join(a, "t").groupBy("s").agg(F.sum("a").alias("h"))
        both = now.select("id", F.col("h").alias("h0"), F.col("a").alias("a0"), F.col("a0").alias("a00"))
        both = both.join(a.select(F.col("t").alias("id"), "a"), "id", "left").join(h.select(F.col("s").alias("id"), "h"), "id", "left")
        both = durable(both.select("id", "h0", "a0", "a00", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h")))
        na, nh, delta = both.agg(F.sqrt(F.sum(F.col("a") ** 2)), F.sqrt(F.sum(F.col("h") ** 2)), F.sum(F.abs(F.col("a0") - F.col("a00")))).first()
        if na is None:
            break
        if tolerance and delta is not None and delta < tolerance:  # the round before was the last one needed: one pass finds lengths and that
            return both.select("id", F.col("a0").alias("Authority"), F.col("h0").alias("Hub"))
        now = both.select("id", (F.col("h") / (nh or 1.0)).alias("h"), (F.col("a") / (na or 1.0)).alias("a"), "a0")
    return now.select("id", F.col("a").alias("Authority"), F.col("h").alias("Hub"))


def compute_hits(graph: Graph, **options) -> tuple[Graph, dict]:
    return _add(graph, hits(graph, **options), ["Authority", "Hub"]), {}


def eigenvector(graph: Graph, rounds: int = 100, shift: float = 1.0, tolerance: float = 1e-10) -> DataFrame:
    """(id, eigencentrality): power iteration on in-edges plus ``shift`` times the node itself, scaled to a greatest value of 1 (Bonacich 1972)."""
    links = durable(flow(graph))
    now = graph.nodes.select("id", F.lit(1.0).alias("v"), F.lit(None).cast("double").alias("old"))
    for _ in range(rounds):
        got = links.join(now.select(F.col("id").alias("s"), "v"), "s").groupBy("t").agg(F.sum("v").alias("x"))
        value = (F.lit(shift) * F.col("v") + F.coalesce("x", F.lit(0.0))).alias("v")
        raw = durable(now.join(got, F.col("id") == F.col("t"), "left").select("id", F.col("v").alias("old"), F.col("old").alias("older"), value))
        top, delta = raw.agg(F.max("v"), F.max(F.abs(F.col("old") - F.col("older")))).first()
        if top is None:
            break
        if tolerance and delta is not None and delta < tolerance:  # as in hits
            return raw.select("id", F.col("old").alias("eigencentrality"))
        now = raw.select("id", (F.col("v") / (top or 1.0)).alias("v"), "old")
    return now.select("id", F.col("v").alias("eigencentrality"))


def compute_eigenvector(graph: Graph, **options) -> tuple[Graph, dict]:
    return _add(graph, eigenvector(graph, **options), ["eigencentrality"]), {}


def triangles(graph: Graph) -> DataFrame:
    """(id, k, t): distinct neighbours and triangles of the nodes with neighbours.

    Edges point from the smaller to the larger degree, so no node starts more than about sqrt(2E) of
    them and hubs do not square the wedges (Latapy 2008).
    """
    pairs = undirected(graph)
    k = durable(pairs.groupBy("s").agg(F.count("*").alias("k")))
    up = pairs.join(k, "s").join(k.select(F.col("s").alias("t"), F.col("k").alias("kt")), "t").where("k < kt OR (k = kt AND s < t)").select("s", "t", "kt")
    up = durable(up)
    a, b = up.select("s", F.col("t").alias("u"), F.col("kt").alias("ku")), up.select("s", F.col("t").alias("v"), F.col("kt").alias("kv"))
    wedges = a.join(b, "s").where("ku < kv OR (ku = kv AND u < v)")
    closed = wedges.join(up.select(F.col("s").alias("u"), F.col("t").alias("v")), ["u", "v"])
    counts = closed.select(F.explode(F.array("s", "u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    return k.select(F.col("s").alias("id"), "k").join(counts, "id", "left").select("id", "k", F.coalesce("t", F.lit(0)).alias("t"))


def clustering(graph: Graph) -> DataFrame:
    """(id, clustering) of all nodes: 2T/(k(k-1)), 0 below two neighbours (Watts & Strogatz 1998)."""
    t = triangles(graph)
    value = F.when(F.col("k") > 1, 2.0 * F.col("t") / (F.col("k").cast("double") * (F.col("k") - 1))).otherwise(0.0)
    return graph.nodes.select("id").join(t, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("clustering"))


def compute_clustering_coefficient(graph: Graph) -> tuple[Graph, dict]:
    values = durable(clustering(graph))
    return _add(graph, values, ["clustering"]), {"average_clustering_coefficient": values.agg(F.coalesce(F.avg("clustering"), F.lit(0.0))).first()[0]}


# ---------------------------------------------------------------- distances


def _brandes(starts: np.ndarray, nexts: np.ndarray, source: int, shares: bool = True):
    """Distances from one node, and (if asked for) each node's share of the shortest paths from it (Brandes 2001)."""
    n = len(starts) - 1
    dist, paths = np.full(n, -1), np.zeros(n)
    dist[source], paths[source] = 0, 1.0
    layers, frontier = [], np.array([source])
    while len(frontier):
        size = starts[frontier + 1] - starts[frontier]
        at = np.repeat(starts[frontier] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        u, v = np.repeat(frontier, size), nexts[at]
        fresh = (dist[v] < 0) | (dist[v] == dist[frontier[0]] + 1)
        u, v = u[fresh], v[fresh]
        dist[v] = dist[frontier[0]] + 1
        if shares:
            np.add.at(paths, v, paths[u])
            layers.append((u, v))
        frontier = np.unique(v)
    share = np.zeros(n)
    for u, v in reversed(layers):
        np.add.at(share, u, paths[u] / paths[v] * (1 + share[v]))
    share[source] = 0
    return dist, share


_DISTANCE_COLUMNS = ["betweenesscentrality", "closnesscentrality", "harmonicclosnesscentrality", "eccentricity"]


def _distances_shared(graph: Graph, links: DataFrame, sources: DataFrame | None, shares: bool = True):
    """Every task runs breadth-first searches for its sources over the same compact adjacency, whose size has been checked."""
    nodes = graph.nodes.select("id").toArrow().column("id").to_pandas()
    index = pd.Series(np.arange(len(nodes)), index=nodes)
    e = links.toArrow()
    s, t = index.loc[e.column("s").to_pandas()].to_numpy(), index.loc[e.column("t").to_pandas()].to_numpy()
    order = np.lexsort((t, s))
    starts = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=len(nodes)))))
    shared = graph.spark.sparkContext.broadcast((starts, t[order].astype(np.int32), nodes.to_numpy()))

    def search(batches):
        starts, nexts, names = shared.value
        place = {k: i for i, k in enumerate(names)}
        total = np.zeros(len(names))
        for batch in batches:
            rows = []
            for name in batch["id"]:
                dist, share = _brandes(starts, nexts, place[name], shares)
                far = dist[dist > 0]
                rows.append((name, 0.0, len(far), float(far.sum()), float((1.0 / far).sum()), int(far.max(initial=0))))
                total += share
            yield pd.DataFrame(rows, columns=["id", "share", "reached", "far", "near", "ecc"])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": names[some], "share": total[some], "reached": 0, "far": 0.0, "near": 0.0, "ecc": 0})

    starts_from = (graph.nodes.select("id") if sources is None else sources.select("id")).repartition(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), "id")
    parts = starts_from.mapInPandas(search, "id string, share double, reached long, far double, near double, ecc int")
    return parts.groupBy("id").agg(F.sum("share").alias("share"), F.sum("reached").alias("reached"), F.sum("far").alias("far"), F.sum("near").alias("near"), F.max("ecc").alias("ecc"))


def _distances_joined(graph: Graph, links: DataFrame, sources: DataFrame | None, shares: bool = True):
    """The same by joins, one layer of all searches at a time; for adjacency too large to share."""
    links = durable(links)
    frontier = (graph.nodes if sources is None else sources).select(F.col("id").alias("o"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("p"))
    found, depth = durable(frontier), 0
    frontier = found
    while True:
        step = frontier.join(links, F.col("v") == F.col("s")).groupBy("o", "t").agg(F.sum("p").alias("p")).withColumnRenamed("t", "v")
        frontier = durable(step.join(found, ["o", "v"], "left_anti").select("o", "v", F.lit(depth + 1).alias("d"), "p"))
        if frontier.isEmpty():
            break
        depth, found = depth + 1, durable(found.unionByName(frontier))
    share = found.where(F.col("d") == depth).select("o", "v", F.lit(0.0).alias("q"))
    done = share
    for d in range(depth if shares else 0, 0, -1):
        layer = found.where(F.col("d") == d).join(share, ["o", "v"], "left").select("o", "v", ((1 + F.coalesce("q", F.lit(0.0))) / F.col("p")).alias("c"))
        up = layer.join(links, F.col("v") == F.col("t")).select("o", F.col("s").alias("u"), "c")
        share = durable(up.join(found.where(F.col("d") == d - 1).select("o", F.col("v").alias("u"), "p"), ["o", "u"]).groupBy("o", "u").agg(F.sum(F.col("c") * F.col("p")).alias("q")).withColumnRenamed("u", "v"))
        done = done.unionByName(share)
    between = done.where("o <> v").groupBy("v").agg(F.sum("q").alias("share")).withColumnRenamed("v", "id")
    far = found.where("d > 0").groupBy(F.col("o").alias("id")).agg(F.count("*").alias("reached"), F.sum("d").cast("double").alias("far"), F.sum(1.0 / F.col("d")).alias("near"), F.max("d").alias("ecc"))
    return graph.nodes.select("id").join(between, "id", "left").join(far, "id", "left").na.fill(0)


def distances(graph: Graph, directed: bool = False, normalized: bool = True, sample: int | None = None, shared: bool | None = None, shares: bool = True) -> tuple[DataFrame, dict]:
    """(id, betweenness, closeness, harmonic closeness, eccentricity) and the path scalars.

    Closeness is reached/sum of distances, harmonic the sum of 1/distance over n-1; nodes that reach
    nothing have 0.  ``sample`` searches from that many nodes chosen by hash and scales betweenness up:
    an approximation for graphs too large for all sources.  Without ``shares`` betweenness is left at 0 and not worked out.
    """
    n = graph.nodes.count()
    links = flow(graph).where("s <> t").distinct() if directed else undirected(graph)
    sources = graph.nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(sample) if sample and sample < n else None
    if shared is None:
        shared = n + links.count() <= MAX_SHARED_NEIGHBOURS
    raw = durable((_distances_shared if shared else _distances_joined)(graph, links, sources, shares))
    scale = (n / sample if sources is not None else 1.0) / (1 if directed else 2)
    if normalized:
        scale = scale / ((n - 1) * (n - 2) / (1 if directed else 2)) if n > 2 else 0.0
    d = F.col("reached")
    out = raw.select(
        "id",
        (F.col("share") * scale).alias("betweenesscentrality"),
        F.when(d > 0, d / F.col("far")).otherwise(0.0).alias("closnesscentrality"),
        (F.col("near") / max(1, n - 1)).alias("harmonicclosnesscentrality"),
        F.col("ecc").cast("double").alias("eccentricity"),
    )
    row = raw.agg(F.sum("far"), F.sum("reached"), F.max("ecc"), F.min(F.when(F.col("ecc") > 0, F.col("ecc")))).first()
    return out, {"average_path_length": row[0] / row[1] if row[1] else 0.0, "diameter": row[2] or 0, "radius": row[3] or 0}


def compute_betweenness(graph: Graph, error: float | None = None, **options) -> tuple[Graph, dict]:
    """With ``error`` betweenness alone, from sampled pairs, none off by more (see :func:`~netlytics.operators.sampling.sampled_betweenness`)."""
    if error is not None:
        values, told = sampled_betweenness(graph, error, **options)
        return _add(graph, values, ["betweenesscentrality"]), told
    values, scalars = distances(graph, **options)
    return _add(graph, values, _DISTANCE_COLUMNS), scalars


def compute_avg_path_length(graph: Graph, **options) -> tuple[Graph, dict]:
    return graph, distances(graph, directed=False, shares=False, **options)[1]
