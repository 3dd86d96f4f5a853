import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from netlytics.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def brute(counts, ratio=2):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = sorted((v for v in counts if one_edit(w, v)), key=lambda v: (-counts[v], v))
        form[w] = near[w][0] if near[w] and counts[near[w][0]] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def grouped(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    return sorted(map(tuple, spelling.group_variants(words, **options).collect()), key=str)


@pytest.mark.parametrize(("local", "first"), [(2, 1), (7, 2), (4096, 2), (3, 3)])
def test_random_vocabularies(spark, local, first):
    r = random.Random(local)
    counts = {"".join(r.choice("abé") for _ in range(r.randint(1, 8))): r.choice([1, 2, 3, 4, 9, 20, 50]) for _ in range(250)}
    assert grouped(spark, counts, local=local, first=first) == brute(counts)


def test_repeated_characters_and_prefix_words(spark):
    """Insertions into runs count once, wherever the subtries are cut; words that are prefixes of others; characters beyond 16 bits."""
    words = ["a" * k for k in range(1, 9)] + ["aab" + "a" * k for k in range(5)] + ["b" + "a" * k for k in range(5)] + ["𝒳yz", "xyz", "𝒳𝒳yz", "yz"]
    counts = {w: i % 5 + 1 for i, w in enumerate(words)}
    for local in (1, 3, 100):
        assert grouped(spark, counts, local=local, first=2) == brute(counts)


def test_forms_in_a_row(spark):
    counts = {"abcdef"[: 6 - i] + "x" * 5: 3**i for i in range(6)}
    rows = {w: root for w, _, root, *_ in grouped(spark, counts)}
    assert set(rows.values()) == {"axxxxx"}
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_very_long_words_beside_many_short_ones():
    words = sorted({f"w{i:04}" for i in range(0, 2000, 7)} | {"w" + "x" * 50_000, "w" + "x" * 49_999 + "y", "w" + "x" * 49_999})
    a, b = spelling.near_words(words, np.ones(len(words), np.int64), np.zeros(len(words), np.int64))
    assert sum(len(words[i]) > 100 for i in a) == 3  # a replaced, and two inserted ones


@pytest.mark.parametrize("drop_every", [None, 5])
def test_words_of_documents(spark, texts, drop_every):
    """Null and empty texts, repeated rows, an absent id, capitals beyond A-Z, a column whose name clashes."""
    rows = [(i, t, "w") for i, t in enumerate(texts)] + [(3, texts[3], "w"), (None, "Émile émile ÉMILE Wörter WÖRTER", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(5)
    want = Counter()
    for i, t, _ in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    got = {r["word"]: r["n"] for r in spelling.count_words(df, drop_every=drop_every, min_chars=2, min_count=2).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 2 and n >= 2}


def test_empty(spark, no_docs):
    assert spelling.group_variants(spelling.count_words(no_docs)).collect() == []
    assert grouped(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
