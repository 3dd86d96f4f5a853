"""Near-copies among embedding vectors of equal label, found by searching a flat graph of neighbours.

Method: vectors are dealt to overlapping shards, those of their nearest cluster centres.  Each shard gets a graph: the robust-pruned
neighbours of every vector (a candidate goes if a kept one is nearer to it, by ``alpha``, than the vector is), and
the nearest ones within the range, which pruning would thin out.  The shards' adjacency lists are united, edges leading both ways.
Then every vector is a query: a greedy search from the shard's medoids (and from the vector itself) leads near it, and the range is
expanded from there over all neighbours that are within it.  Each link is verified by the cosine in double precision.
A pair that several shards hold is counted in the first of them.  :func:`audit_recall` measures against brute force.

Equal vectors are one vector that counts as often as there are copies, so copies are never paired.  Centres are fitted on
a bounded sample (``sample`` rows); every vector is indexed and searched.  A shard over ``shard_rows`` is cut into blocks
by a hash, and every pair of its blocks has a graph of its own: no task holds more, and no pair is left out.  That is quadratic in such a shard: a
group of near-copies that is larger than a shard costs its square, as its links are that many.

Odd rows: vectors that are absent, zero, or hold absent or non-finite components link with nothing, nor do those without a
label or of different lengths.  Every row is a vector; ids may be of any type, absent or shared (rows then get an order by id, absent ones
last, and a component is named by its first row's id).  An empty table gives an empty table.  Other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import bounded, materialize, with_rows
from .components import connected_components

# ---------------------------------------------------------------- vectors


def _valid_vectors(rows: DataFrame, dtype: str) -> DataFrame:
    """(row, key, raw): rows that can have links; key is label and length, raw the components' bytes."""

    def check(batches):
        for batch in batches:
            ids, keys, raws = [], [], []
            for i, label, v in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(dtype)
                if np.isfinite(x).all() and x.any():
                    ids.append(i.as_py())
                    keys.append(f"{len(x)}:{label.as_py()}")
                    raws.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(raws, pa.binary())], names=["row", "key", "raw"])

    return rows.where("label IS NOT NULL AND vec IS NOT NULL").mapInArrow(check, "row long, key string, raw binary")


def units(raws: list[bytes], dtype: str) -> np.ndarray:
    """Unit vectors in double precision; each is scaled by its largest component first, so that no length overflows."""
    x = np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---------------------------------------------------------------- overlapping shards


def fit_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centres of unit vectors, by spherical k-means from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _centres(vectors: DataFrame, dtype: str, *, shard_rows: int, overlap: int, sample: int, max_centres: int) -> dict[str, np.ndarray]:
    """Centres of each key that has more rows than a shard, ``max_centres`` in all at most; other keys are one shard."""
    aim = shard_rows / 2.5
    large = vectors.groupBy("key").count().where(F.col("count") > shard_rows).orderBy(F.col("count").desc(), "key").limit(max_centres // 2).collect()
    if not large:
        return {}
    wanted = {r["key"]: max(2, int(np.ceil(r["count"] * overlap / aim))) for r in large}
    share = min(1.0, max_centres / sum(wanted.values()))
    some = vectors.where(F.col("key").isin(list(wanted))) if len(wanted) <= 100 else vectors
    taken: dict[str, list[bytes]] = {}
    for r in some.orderBy(F.xxhash64("row")).limit(sample).collect():
        if r["key"] in wanted:
            taken.setdefault(r["key"], []).append(bytes(r["raw"]))
    return {key: fit_centres(units(raws, dtype), max(2, int(wanted[key] * share))) for key, raws in sorted(taken.items())}


def _assign(shared, dtype: str, overlap: int):
    """Rows (row, key, raw, copies) with ``shards``: the ascending numbers of the nearest centres."""

    def run(batches):
        for batch in batches:
            keys, shards = batch.column(1).to_pylist(), [[0]] * batch.num_rows
            for key in set(keys) & shared.value.keys():
                at = [i for i, k in enumerate(keys) if k == key]
                near = units([batch.column(2)[i].as_py() for i in at], dtype) @ shared.value[key].T
                best = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :overlap], axis=1)
                for i, b in zip(at, best.tolist(), strict=True):
                    shards[i] = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], names=["row", "key", "raw", "copies", "shards"])

    return run


# ---------------------------------------------------------------- the graph of a shard


def prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Robust pruning: of each row of ``candidates`` (nearest first) those that no kept one occludes; -1 for the others."""
    c = x[candidates]
    to = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qcd,qd->qc", c, x[of])))
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(c, c.transpose(0, 2, 1))))
    alive, rows = candidates != of[:, None], np.arange(len(of))
    kept = np.full((len(of), degree), -1)
    for j in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        kept[some, j] = candidates[rows[some], pick[some]]
        alive &= alpha * between[rows, pick] > to
        alive[rows, pick] = False
    return kept


def shard_graph(x: np.ndarray, threshold: float, *, alpha: float, degree: int, near: int, breadth: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of the graph of unit vectors ``x``: pruned neighbours among the ``breadth`` nearest, and the ``near`` nearest within the threshold."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out_a, out_b = [], []
    for start in range(0, n, 256):
        of = np.arange(start, min(n, start + 256))
        sims = x[of] @ x.T
        sims[np.arange(len(of)), of] = -np.inf
        k = min(breadth, n - 1)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(sims, best, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
        pruned = prune(x, of, best, alpha, degree)
        close = np.where(value[:, :near] >= threshold, best[:, :near], -1)
        both = np.concatenate((pruned, close), axis=1)
        hit = both >= 0
        out_a.append(np.repeat(of, hit.sum(axis=1)))
        out_b.append(both[hit])
    return np.concatenate(out_a), np.concatenate(out_b)


def _expand(start: np.ndarray, nodes: np.ndarray, starts: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) for each neighbour of the nodes that queries stand at."""
    size = starts[nodes + 1] - starts[nodes]
    at = np.repeat(starts[nodes], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(start, size), nexts[at]


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """The vector nearest to the mean, then each time the one least similar to those taken."""
    first = int((x @ x.mean(axis=0)).argmax())
    out, most = [first], x @ x[first]
    while len(out) < min(count, len(x)):
        out.append(int(most.argmin()))
        most = np.maximum(most, x @ x[out[-1]])
    return np.unique(out)


def range_search(x: np.ndarray, starts: np.ndarray, nexts: np.ndarray, threshold: float, *, beam: int, entries: int) -> np.ndarray:
    """A symmetric matrix of the links found: for every vector a greedy search from the medoids over the lists ``nexts[starts[i]:starts[i + 1]]``, then expansion within the threshold."""
    n = len(x)
    found, first = np.zeros((n, n), bool), medoids(x, entries)
    for low in range(0, n, 256):
        q = np.arange(low, min(n, low + 256))
        m = len(q)
        seen, mine = np.zeros((m, n), bool), x[q]
        seen[:, first] = True
        of, node = np.repeat(np.arange(m), len(first)), np.tile(first, m)
        sim, done = (mine @ x[first].T).ravel(), np.zeros(m * len(first), bool)
        hits = np.zeros((m, n), bool)
        hits[of[sim >= threshold], node[sim >= threshold]] = True
        while True:
            order = np.lexsort((-sim, of))  # each query's best ``beam`` stay
            of, node, sim, done = of[order], node[order], sim[order], done[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            stay = rank < beam
            of, node, sim, done = of[stay], node[stay], sim[stay], done[stay]
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            todo = todo[np.concatenate(([True], of[todo][1:] != of[todo][:-1]))]  # the best that is not expanded yet
            done[todo] = True
            a, b = _expand(of[todo], node[todo], starts, nexts)
            new = ~seen[a, b]
            a, b = a[new], b[new]
            seen[a, b] = True
            near = np.einsum("pd,pd->p", mine[a], x[b])
            hits[a[near >= threshold], b[near >= threshold]] = True
            of, node, sim, done = np.concatenate((of, a)), np.concatenate((node, b)), np.concatenate((sim, near)), np.concatenate((done, np.zeros(len(a), bool)))
        hits[np.arange(m), q] = True  # a query's own node is a start, too
        seen |= hits
        a, b = np.nonzero(hits)
        while len(a):
            a, b = _expand(a, b, starts, nexts)
            fresh = np.zeros((m, n), bool)
            fresh[a, b] = True
            fresh &= ~seen
            seen |= fresh
            a, b = np.nonzero(fresh)
            close = np.concatenate([np.einsum("pd,pd->p", mine[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) >= threshold if len(a) else np.zeros(0, bool)
            a, b = a[close], b[close]
            hits[a, b] = True
        found[q] = hits
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of each node the first node that it is connected to; pairs are followed from the lower node's label down until nothing changes."""
    label = np.arange(len(found))
    a, b = np.nonzero(found)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (label == before).all():
            break
    return label


# ---------------------------------------------------------------- links

_UNIT = ["key", "shard", "i", "j"]


def _graphs(dtype: str, threshold: float, options: dict):
    def run(table: pa.Table) -> pa.Table:
        rows = table.column("row").to_numpy()
        a, b = shard_graph(units(table.column("raw").to_pylist(), dtype), threshold, **options)
        return pa.table({"a": rows[a], "b": rows[b]})

    return run


def _searches(dtype: str, threshold: float, options: dict):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("row").to_numpy())))
        rows, block, copies = (table.column(c).to_numpy() for c in ("row", "block", "copies"))
        x = units(table.column("raw").to_pylist(), dtype)
        lists = table.column("nexts").combine_chunks()
        size = np.array(lists.value_lengths().fill_null(0))
        to = np.array(lists.flatten(), np.int64)
        place = np.minimum(np.searchsorted(rows, to), len(rows) - 1)
        here, own = rows[place] == to, np.repeat(np.arange(len(rows)), size)
        starts = np.concatenate(([0], np.cumsum(np.bincount(own[here], minlength=len(rows)))))
        found = range_search(x, starts, place[here], threshold, **options)
        least = _smallest(found)
        # A pair counts in the first shard that holds both, and there in the pair of their blocks.
        shard, i, j = table.column("shard")[0].as_py(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        shards = table.column("shards").combine_chunks()
        lengths = np.array(shards.value_lengths())
        width = int(lengths.max())
        earlier = np.full((len(rows), width), -1)
        earlier[np.arange(width) < lengths[:, None]] = np.array(shards.flatten(), np.int64)
        earlier[earlier >= shard] = -1
        a, b = np.nonzero(found)
        counts = np.zeros(len(a), bool)
        for u in range(width):
            for v in range(width):
                counts |= (earlier[a, u] == earlier[b, v]) & (earlier[a, u] >= 0)
        counts = ~counts & ((i == j) | (block[a] != block[b]))
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, a[counts], copies[b[counts]])
        return pa.table({"row": rows, "links": links, "least": rows[least]})

    return run


def near_links(
    vectors: DataFrame, dtype: str, *, threshold: float, shard_rows: int = 2000, overlap: int = 3, sample: int = 20_000, max_centres: int = 4096, alpha: float = 1.2, degree: int = 16, near: int = 8, beam: int = 8, entries: int = 8
) -> DataFrame:
    """(row, links, least) for each shard of each vector of ``vectors`` (row, key, raw, copies): how many vectors it links to there, copies included, and the first that it is connected to there."""
    shared = vectors.sparkSession.sparkContext.broadcast(_centres(vectors, dtype, shard_rows=shard_rows, overlap=overlap, sample=sample, max_centres=max_centres))
    dealt = vectors.select("row", "key", "raw", "copies").mapInArrow(_assign(shared, dtype, overlap), "row long, key string, raw binary, copies long, shards array<int>")
    dealt = dealt.withColumn("shard", F.explode("shards"))
    sizes = dealt.groupBy("key", "shard").count().where(F.col("count") > shard_rows)
    sizes = materialize(sizes.select("key", "shard", F.ceil(F.col("count") / (shard_rows / 2)).cast("int").alias("blocks")), "vector-blocks")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = dealt.join(sizes, ["key", "shard"], "left").withColumn("block", F.pmod(F.xxhash64("row", F.lit(5)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row", "block", "copies", "raw", "shards")
    rows = materialize(rows, "vector-shards")
    graph = rows.select(*_UNIT, "row", "raw").groupBy(*_UNIT).applyInArrow(_graphs(dtype, threshold, {"alpha": alpha, "degree": degree, "near": near}), "a long, b long")
    graph = materialize(graph, "vector-edges")
    lists = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("row")).agg(F.collect_set("b").alias("nexts"))
    return rows.join(lists, "row", "left").groupBy(*_UNIT).applyInArrow(_searches(dtype, threshold, {"beam": beam, "entries": entries}), "row long, links long, least long")


def near_copies(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, **options) -> DataFrame:
    """One row for each vector: ``id_col``, n_links (vectors linked directly), component_id (the smallest id reachable by links), kept (whether that is its own).  ``options`` as for :func:`near_links`."""
    bounded(df)
    dtype = "<f4" if df.schema[vector_col].dataType in (ArrayType(FloatType(), True), ArrayType(FloatType(), False)) else "<f8"
    given = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if dtype == "<f4" else "array<double>").alias("vec"))
    rows, plain = with_rows(given, "row", id_col="id", text_col="vec")
    vectors = materialize(_valid_vectors(rows.select("row", "label", "vec"), dtype), "vectors")
    digest = F.unhex(F.sha2("raw", 256))
    groups = vectors.groupBy("key", digest.alias("digest")).agg(F.min("row").alias("first"), F.count("*").alias("copies"))
    groups = materialize(groups, "vector-copies")
    distinct = vectors.join(groups.select(F.col("first").alias("row"), "copies"), "row")
    found = materialize(near_links(distinct, dtype, threshold=threshold, **options), "vector-links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b")), "vector-cc")
    reached = groups.join(links, groups["first"] == links["row"], "left").drop("row").join(components, F.col("first") == F.col("node"), "left")
    reached = reached.select("key", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component"))
    # A group of copies may be large: its rows are told its figures by a join that can be split.
    told = vectors.select("row", "key", digest.alias("digest")).join(reached, ["key", "digest"]).select("row", "n_links", "component")
    out = rows.select("id", "row").join(told, "row", "left").select("id", "row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row").alias("component"))
    if plain:
        return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("component") == F.col("row")).alias("kept"))
    names = rows.select(F.col("row").alias("component"), F.col("id").alias("component_id"))
    return out.join(names, "component").select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("component") == F.col("row")).alias("kept"))


def audit_recall(df: DataFrame, result: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, queries: int = 500) -> tuple[int, int]:
    """(links found, links there are) of at most ``queries`` vectors, chosen by a hash of their distinct integer ids, against all others by brute force."""
    dtype = "<f8"
    given = df.select(F.col(id_col).cast("long").alias("row"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    vectors = materialize(_valid_vectors(given, dtype), "audit")
    some = vectors.orderBy(F.xxhash64("row")).limit(queries).collect()
    by_key: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for key in {r["key"] for r in some}:
        mine = [r for r in some if r["key"] == key]
        by_key[key] = np.array([r["row"] for r in mine]), units([bytes(r["raw"]) for r in mine], dtype)
    shared = vectors.sparkSession.sparkContext.broadcast(by_key)

    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(1).to_pylist()
            for key in set(keys) & shared.value.keys():
                ids, x = shared.value[key]
                at = [i for i, k in enumerate(keys) if k == key]
                near = units([batch.column(2)[i].as_py() for i in at], dtype) @ x.T >= threshold
                near &= batch.column(0).to_numpy()[at][:, None] != ids
                for i, n in zip(ids.tolist(), near.sum(axis=0).tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["row", "n"])

    there = vectors.mapInArrow(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
    row = there.join(result.select(F.col(id_col).alias("row"), "n_links"), "row").agg(F.sum("n_links").alias("found"), F.sum("n").alias("n")).first()
    return int(row["found"] or 0), int(row["n"] or 0)
