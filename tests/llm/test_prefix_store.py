"""Budgets from stored prefix counts against the library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from netlytics.llm import prefix_store  # noqa: E402
from netlytics.llm.queries import tokenizer_path  # noqa: E402


def test_two_budgets_from_one_table(spark, tmp_path):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = ["", None, "Hello  world's  \n\n it'll <|endoftext|>go!! 1234", "été ß漢字 🙂🙂", "   leading", "a" * 3000, "same", "same"]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = [(f"d{min(i, 6)}", t, 7) for i, t in enumerate(texts)]  # the last two rows are one document twice
    path = str(tmp_path / "stored")
    prefix_store.store_prefixes(spark.createDataFrame(rows, "doc_id string, text string, budget int"), tokenizer_path()).write.parquet(path)
    stored = spark.read.parquet(path)
    totals = sorted((r.doc_id, r.n_chars, r.n_tokens) for r in stored.collect())
    assert totals == sorted((d, len(t or ""), count(t or "")) for d, t, _ in rows)
    got = sorted(tuple(r) for r in prefix_store.fit_budgets(stored, [0, 5, 12, -1]).collect())
    want = []
    for d, t, _ in rows:
        counts = [count((t or "")[:c]) for c in range(len(t or "") + 1)]
        for b in (0, 5, 12, -1):
            fit = max((c for c, n in enumerate(counts) if n <= b), default=0)
            want.append((d, b, fit, counts[fit]))
    assert got == sorted(want)
    for cut in (-3, 0, 4, 10**6):
        at = {(r.doc_id, r.n_tokens) for r in prefix_store.counts_at(stored.withColumn("cut", F.lit(cut)), "cut").collect()}
        assert at == {(d, count((t or "")[: max(cut, 0)])) for d, t, _ in rows}


def test_empty_table_and_wide_steps(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    stored = prefix_store.store_prefixes(none, tokenizer_path())
    assert stored.collect() == prefix_store.fit_budgets(stored, [3]).collect() == []
    counts = np.array([0, 1, 70_000, 2])
    assert prefix_store._unpacked(prefix_store._packed(counts)).tolist() == counts.tolist()
