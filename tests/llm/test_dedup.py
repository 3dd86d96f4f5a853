import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netlytics.llm import components, jaccard_join, line_dedup, queries, repeats

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


# ---------------------------------------------------------------- lines


def brute_lines(texts, min_chars, min_docs):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    where = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(where[key(x)]) >= min_docs and max(where[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("min_chars", "min_docs"), [(20, 3), (1, 2)])
def test_line_dedup(docs, texts, min_chars, min_docs):
    out = line_dedup.dedup_lines(docs, min_chars=min_chars, min_docs=min_docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()} == brute_lines(texts, min_chars, min_docs)


def test_one_line_in_most_documents(spark):
    texts = [f"the same long line for all of them\nown line of number {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(texts, 20, 3)


def test_streaming_over_batches():
    """Runs of any length, cut into batches and tasks anywhere, are decided alike."""
    import pyarrow as pa

    rows = sorted((h, 0, -d, p) for h in range(6) for d in range([1, 2, 3, 9, 40, 2][h]) for p in range(1 + d % 2))
    rows = [(h, g, -d, p) for h, g, d, p in rows]
    for tasks in (1, 3):
        dropped, pending, counts = set(), [], collections.Counter()
        bounds = [0, *sorted(random.Random(tasks).sample(range(1, len(rows)), tasks - 1)), len(rows)]
        while any(0 < b < len(rows) and rows[b - 1][:3] == rows[b][:3] for b in bounds):  # a (hash, document) is in one task
            bounds = [b + (0 < b < len(rows) and rows[b - 1][:3] == rows[b][:3]) for b in bounds]
        for a, b in zip(bounds, bounds[1:], strict=False):
            batches = [pa.RecordBatch.from_arrays([pa.array(np.array([r[i] for r in rows[k : min(b, k + 5)]], np.int64)) for i in range(4)], names=["h1", "h2", "doc", "pos"]) for k in range(a, b, 5)]
            for out in line_dedup._stream(3)(iter(batches)):
                for kind, h1, _, doc, pos, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    if kind == 0:
                        dropped.add((h1, doc, pos))
                    elif kind == 1:
                        pending.append((h1, doc, pos))
                    else:
                        counts[h1] += n
        greatest = {h: max(d for x, _, d, _ in rows if x == h) for h in range(6)}
        dropped |= {x for x in pending if counts[x[0]] >= 3 and x[1] != greatest[x[0]]}
        number = {h: len({d for x, _, d, _ in rows if x == h}) for h in range(6)}
        assert dropped == {(h, d, p) for h, _, d, p in rows if number[h] >= 3 and d != greatest[h]}


def test_bitmaps():
    bitmap = line_dedup.pack_bitmap(np.array([0, 9]))
    assert line_dedup.kept_lines(bitmap, 20).tolist() == [i not in (0, 9) for i in range(20)]
    assert line_dedup.kept_lines(None, 3).all()


# ---------------------------------------------------------------- near copies


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("options", [{"k": 4, "num": 85}, {"k": 5, "num": 80, "max_group": 3, "pivots": 1}, {"k": 2, "num": 50, "universe": 1}])
def test_similar_components(docs, texts, options):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, **options).collect()}
    assert got == brute_components(texts, options["k"], options["num"], 100)


def test_keep_one(docs, texts):
    kept = jaccard_join.keep_one_of_each(docs, k=4, num=85)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute_components(texts, 4, 85, 100).items() if c == i}


def chains_and_passages():
    """Documents that share elements with many others, but have few links: parts of one long text that overlap by two thirds, and own words around a common passage; some near copies of both."""
    r = random.Random(9)
    long = [f"w{r.randrange(10**6)}" for _ in range(2400)]
    texts = [" ".join(long[i : i + 30 + i // 10 % 40]) for i in range(0, 1500, 10)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} {' '.join(f'own{i}x{j}' for j in range(24))}" for i in range(60)]
    return texts + [t + " more" for t in texts[::15]]


def test_no_tree_takes_a_whole_large_component(spark, monkeypatch):
    texts, largest, solve = chains_and_passages(), [], jaccard_join._solve

    def watched(groups, num, den):
        largest.append(groups.groupBy("key", "part").agg(F.countDistinct("doc").alias("n")).agg(F.max("n")).first()[0])
        return solve(groups, num, den)

    monkeypatch.setattr(jaccard_join, "_solve", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df, k=2, num=85, max_group=16, pivots=2).collect()}
    assert got == brute_components(texts, 2, 85, 100)
    assert len(largest) == 2 and max(largest) <= 3 * 16  # two blocks, dealt by hash; there were over 100 documents in a tree


@pytest.mark.parametrize("max_bytes", [600, 16 << 20])
def test_large_components_are_narrowed(spark, max_bytes):
    texts = chains_and_passages()[150:]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df, k=2, num=85, max_group=16, max_bytes=max_bytes, pivots=2, narrow_over=16).collect()}
    assert got == brute_components(texts, 2, 85, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=1, max_size=25), st.sampled_from([50, 80, 85]))
def test_signature_tree_finds_all_links(sets, num):
    arrays = [np.unique(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    got = jaccard_join.linked_labels(arrays, num, 100)
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(len(sets)) for j in range(i))


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60) if i not in (20, 40)] + [(100, i) for i in range(101, 130)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert {r.node: r.component for r in got} == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


# ---------------------------------------------------------------- repeats


def brute_repeats(texts, length):
    raws = {i: (t or "").encode() for i, t in enumerate(texts)}
    seen = collections.Counter(x[i : i + length] for x in raws.values() for i in range(len(x) - length + 1))
    out = {}
    for k, x in raws.items():
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[k] = (len(x), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("options", [{"length": 40}, {"length": 20, "hot": 3}, {"length": 60, "gram": 45, "bucket_bytes": 200}])
def test_remove_repeats(docs, texts, options):
    out = repeats.remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute_repeats(texts, options["length"])


def test_suffix_dedup_query(spark, tmp_path):
    """The contract's columns come first, in its order. Copied passages of over 50 words stay below 400 bytes and go from there on."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(LOWER) for _ in range(r.randint(3, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    short, long, accents = " ".join(r.choice(LOWER) * 4 for _ in range(60)), prose(120), " ".join("é" * r.randint(1, 5) + r.choice(LOWER) for _ in range(60))
    assert len(short.encode()) < 400 < len(long) and len(accents) < 400 < len(accents.encode())
    texts = [f"{prose(30)} {p} {prose(30)}" for p in (short, short, long, long, accents, accents)] + [prose(200), short, long[:399], long[1:401], None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_suffix_dedup(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = out.collect()
    assert {x[0]: tuple(x[1:5]) for x in rows} == brute_repeats(texts, 400)
    assert all(x.n_kept == x.n_bytes - x.n_removed for x in rows)
    assert [x.doc_id for x in sorted(rows) if x.n_removed] == [2, 3, 4, 5, 9]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=6))
def test_run_length_index(texts):
    index = repeats.RunLengthIndex([t.encode() for t in texts])
    best = index.longest_elsewhere()
    suffixes = [(k, i, t[i:]) for k, t in enumerate(texts) for i in range(len(t))]
    for k, i, s in suffixes:
        want = 0
        for k2, i2, s2 in suffixes:
            if (k, i) != (k2, i2):
                n = 0
                while n < min(len(s), len(s2)) and s[n] == s2[n]:
                    n += 1
                want = max(want, n)
        assert best[index.starts[k] + i] == want


def test_empty_tables(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert jaccard_join.similar_components(no_docs).count() == 0
    assert repeats.remove_repeats(no_docs).count() == 0
