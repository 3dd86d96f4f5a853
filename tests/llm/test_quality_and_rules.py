import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlytics.llm import line_rules, quality

CLEAN = "The people went along the river and talked about the weather of that day. "


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        words = [w for w in CLEAN.split() for _ in range(1)]
        words = words[i % 7 :] + words[: i % 11]
        good = i % 3 > 0
        text = " ".join(words) * (1 + i % 5) if good else "\n".join(" ".join(w.upper() + "$$$ ###" for w in words) for _ in range(1 + i % 4))
        rows.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    out = quality.score(docs, quality.train(docs, labels)).withColumn("held_out", quality.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    test = [r for r in out if r.held_out]
    assert len(test) > 50 and np.mean([r.predicted == r.quality for r in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_scores_do_not_depend_on_neighbours(labelled, docs, texts):
    model = quality.train(*labelled)
    together = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(together) == len(texts)
    for i, t in enumerate(texts):
        assert abs(together[i] - model.scores([(t or "").encode()])[0]) < 1e-9


def test_gradients():
    r = np.random.RandomState(0)
    model = quality.AttentionModel(width=4, attention=3)
    x, bags, y = r.rand(7, quality.N_FEATURES), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    grads = model.gradients(x, bags, y, np.ones(3))

    def loss():
        p = model.forward(x, bags)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, place in (("E", (5, 1)), ("V", (1, 2)), ("U", (0, 1)), ("a", (1,)), ("c", (2,)), ("b", (0,))):
        old = model.p[name][place]
        model.p[name][place] = old + 1e-5
        up = loss()
        model.p[name][place] = old - 1e-5
        down = loss()
        model.p[name][place] = old
        assert abs((up - down) / 2e-5 - grads[name][place]) < 1e-6


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(2, 1)], 0.5), ([(1, 1)], 1.0), ([(1, 0), (0, 0)], 0.0), ([(1, 0), (1, 1)], 0.5)])
def test_nothing_to_learn(docs, no_docs, spark, labels, want):
    """A constant score; lines are all content.  (Document 2 is held out.)"""
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).select("score", "predicted").distinct().collect()
    assert [(r.score, r.predicted) for r in got] == [(want, int(want >= 0.5))]
    assert quality.score(no_docs, quality.train(no_docs, labels)).count() == 0
    field = line_rules.train(docs, labels.limit(1))
    assert all(r.kept != r.base_failed for r in line_rules.apply_rules(docs, field).collect())


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(again)


def test_rules(labelled, docs, texts):
    field = line_rules.train(*labelled)
    got = {r.doc_id: r for r in line_rules.apply_rules(docs, field).collect()}
    for i, t in enumerate(texts):
        n, *rest = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
        assert not (r.kept and r.base_failed)


def test_line_field_tells_lines_apart(labelled):
    docs, labels = labelled
    field = line_rules.train(docs, labels)
    out = line_rules.apply_rules(docs, field, min_words=1, max_repeat=(100, 100)).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in out]) > 0.95


def test_viterbi_is_the_best_labelling():
    import itertools

    r = np.random.RandomState(2)
    for _ in range(50):
        field = line_rules.LineField(r.randn(3), abs(r.randn()))
        x = r.randn(6, 3)
        value = lambda y: float(np.dot(x @ field.emission, y)) + field.stay * sum(a == b for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert abs(value(tuple(field.viterbi(x).astype(int))) - value(best)) < 1e-9


def test_empty_tables(labelled, no_docs):
    assert quality.score(no_docs, quality.train(*labelled)).count() == 0
    assert line_rules.apply_rules(no_docs, line_rules.train(*labelled)).count() == 0
