import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from netlytics.llm import packing, token_counts  # noqa: E402
from netlytics.llm.queries import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(docs, texts, library):
    got = {r.doc_id: r for r in token_counts.token_counts(docs, tokenizer_path(), limit=50).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(ids(library, t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50)
        assert got[i].fit_chars == max(c for c in range(min(len(t or ""), 400) + 1) if len(ids(library, (t or "")[:c])) <= 50) or len(t) > 400


def test_every_prefix(library):
    tokenizer = token_counts.load(tokenizer_path())
    r = random.Random(5)
    samples = ["Hello  world's  \n\n it'll <|endoftext|>go!! 1234", "   leading", "<|endoftext|", "été ß漢字 🙂🙂", "a\t\n b"]
    samples += ["".join(r.choice(" ab'slE.\n1é<|>") for _ in range(60)) for _ in range(20)]
    samples += ["".join(r.choice(["'ll", "'re", "'", "\n", " ", "  ", "\u3000", "x", "!", "<|endoftext|>", "9", "\x1f"]) for _ in range(25)) for _ in range(30)]
    for text in samples:
        index = tokenizer.index(text)
        for budget in (0, 1, 5, 17):
            assert tokenizer.fit(text, budget) == tokenizer.index(text, budget).fit(budget) == index.fit(budget) == max(c for c in range(len(text) + 1) if index.count(c) <= budget)
        assert index.total() == len(ids(library, text))
        for cut in range(len(text) + 1):
            assert index.count(cut) == len(ids(library, text[:cut])), (text, cut)


def test_a_very_long_word():
    """One pass, whatever the length."""
    index = token_counts.load(tokenizer_path()).index("a" * 300_000)
    assert len(index.counts) == 300_001 and index.count(index.fit(1000)) <= 1000 < index.count(index.fit(1000) + 1)


def test_truncation(spark, library):
    df = spark.createDataFrame([(1, "some words and some more words " * 20), (2, None), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.truncate_to_budget(df, tokenizer_path(), 10).collect()}
    assert got[1].n_tokens <= 10 and len(ids(library, got[1].text)) == got[1].n_tokens
    assert got[2].text == "" and got[3].text == "short"


def test_empty_table(no_docs):
    assert token_counts.token_counts(no_docs, tokenizer_path()).count() == 0
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("parts", [1, 20])
def test_packing(docs, texts, library, parts):
    capacity = 64
    got = packing.pack_documents(docs.repartition(parts, "doc_id"), tokenizer_path(), capacity=capacity, fan_in=3).toPandas()
    total = 0
    for i, t in enumerate(texts):
        want = np.array([*ids(library, t), 0], "<u4")
        total += len(want)
        pieces = got[got.doc_id == i].sort_values("piece")
        assert pieces.piece.tolist() == list(range(-(-len(want) // capacity)))
        assert pieces.length.sum() == len(want) and (pieces.length.iloc[1:] == capacity).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length.to_numpy())[:-1]] and s.length.sum() <= capacity
    assert got.sequence_id.nunique() <= 1.1 * -(-total // capacity)


def test_best_fit_prefers_the_tightest_bin():
    place, offset, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fills.tolist() == [10, 10] and place[2] == place[0] and offset[2] == 6
