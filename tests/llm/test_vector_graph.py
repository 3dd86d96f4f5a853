import numpy as np
import pytest

from netlytics.llm import vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, row string, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)


def brute(rows, threshold=0.98):
    """All rows' links by the whole matrix of cosines."""
    n = len(rows)
    linked = np.zeros((n, n), bool)
    good = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                linked[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    reach = linked | np.eye(n, dtype=bool)
    for _ in range(n):
        more = reach @ reach
        if (more == reach).all():
            break
        reach = more
    ids = np.array([r[0] for r in rows])
    return sorted((int(ids[i]), int(linked[i].sum()), int(ids[reach[i]].min()), bool(ids[reach[i]].min() == ids[i])) for i in range(n))


def clusters(seed, n, dim=24, sizes=(60, 25, 8, 3, 2)):
    r = np.random.RandomState(seed)
    out = [r.randn(dim) for _ in range(n)]
    for size in sizes:
        centre = r.randn(dim)
        out += [centre * r.uniform(0.5, 3) + 0.08 * r.randn(dim) for _ in range(size)]
    r.shuffle(out)
    return [(i, [float(x) for x in np.float32(v)], i % 2) for i, v in enumerate(out)]


def links(result):
    return sorted(map(tuple, result.collect()))


def test_one_shard(spark):
    rows = clusters(1, 100)
    assert links(vector_graph.near_copies(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("shard_rows", [60, 20])
def test_overlapping_shards_and_blocks(spark, shard_rows):
    """Small shards, some of them cut into blocks: recall is at least 0.9, and nothing is linked that should not be."""
    rows = clusters(2, 300, sizes=(90, 40, 10, 10, 3, 3, 2, 2))
    df = frame(spark, rows)
    result = vector_graph.near_copies(df, shard_rows=shard_rows)
    got, want = links(result), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    found, there = vector_graph.audit_recall(df, result, queries=1000)
    assert there == sum(w[1] for w in want) and found == sum(g[1] for g in got)
    assert found >= 0.9 * there


def test_graph_and_search_of_a_shard():
    r = np.random.RandomState(4)
    x = r.randn(400, 16)
    x[100:300] = x[100] + 0.1 * r.randn(200, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = vector_graph.shard_graph(x, 0.98, alpha=1.2, degree=12, near=6)
    assert np.bincount(a).max() <= 18 and (a != b).all()
    both = np.unique(np.stack((np.concatenate((a, b)), np.concatenate((b, a))), axis=1), axis=0)
    starts = np.concatenate(([0], np.cumsum(np.bincount(both[:, 0], minlength=400))))
    found = vector_graph.range_search(x, starts, both[:, 1], 0.98, beam=8, entries=4)
    true = (x @ x.T >= 0.98) & ~np.eye(400, dtype=bool)
    assert not (found & ~true).any() and (found & true).sum() >= 0.95 * true.sum()


def test_pruned_neighbours_are_not_occluded():
    x = np.random.RandomState(5).randn(50, 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x.T), axis=1)[:, :20]
    kept = vector_graph.prune(x, np.arange(50), near, 1.2, 8)
    d = lambda i, j: np.linalg.norm(x[i] - x[j])
    for i, row in enumerate(kept):
        want = []
        for c in near[i]:
            if c != i and len(want) < 8 and all(1.2 * d(k, c) > d(i, c) for k in want):
                want.append(c)
        assert row[row >= 0].tolist() == want


def test_copies_count_without_pairs(spark):
    """A third of the rows is one vector: its copies are one node of the graph."""
    rows = clusters(3, 20, sizes=(3,))
    rows += [(100 + i, rows[0][1], 0) for i in range(300)] + [(900, [2 * x for x in rows[0][1]], 0)]
    assert links(vector_graph.near_copies(frame(spark, rows), shard_rows=50)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0] * 3, 0), (7, [1.0, None, 3.0], 0), (8, [1.0, nan, 3.0], 0), (9, [1.0, inf, 3.0], 0), (10, [*v, 4.0], 0),
            (11, [3e38, 3e38, 3e38], 1), (12, [1e-40, 1e-40, 1e-40], 1), (13, [-1.0, -2.0, -3.0], 0), (14, [0.01 * x for x in v], 0), (-7, v, 1)]
    got = {r[0]: r[1:] for r in vector_graph.near_copies(frame(spark, rows)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[14] == (2, 1, False)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 13, -7))


def test_odd_ids_and_empty(spark):
    """Shared and absent ids, ids that are texts: each row is a vector; a component is named by its first row's id."""
    v, w = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([("b", v, 1), ("b", v, 1), (None, v, 1), ("a", w, 1), (None, w, 2)], "vec_id string, embedding array<double>, label long")
    got = sorted(vector_graph.near_copies(df).collect(), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("b", 2, "b", True), ("b", 2, "b", False), (None, 2, "b", False), ("a", 0, "a", True), (None, 0, None, True)]))
    empty = df.where("false")
    assert vector_graph.near_copies(empty).collect() == []
    assert vector_graph.near_copies(empty).columns == ["vec_id", "n_links", "component_id", "kept"]
