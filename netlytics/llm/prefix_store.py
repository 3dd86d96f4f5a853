"""Prefix token counts stored with the documents: budgets are answered from the table, without a tokenizer or the texts.

``token_counts.PrefixIndex`` knows the exact count of every prefix of a text.  ``store_prefixes`` keeps it as a
column: the steps from each prefix to the next one, which are small, compressed (on prose about a tenth of the text).  ``fit_budgets`` and
``counts_at`` read that column alone, so a second budget costs no encoding.

Nulls count as the empty text (no characters, no tokens), repeated rows have an answer each, an empty table gives an empty one, texts of any length are
stored whole, ids may be of any type, and columns other than those named are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded
from .token_counts import load


def _packed(counts: np.ndarray) -> bytes:
    """Steps between the counts of prefixes; steps of two bytes where all of them fit, else of four, and a first byte that says which."""
    steps = np.diff(counts)
    width = 2 if not len(steps) or np.abs(steps).max() < 1 << 15 else 4
    return bytes([width]) + zlib.compress(steps.astype(f"<i{width}").tobytes())


def _unpacked(stored: bytes) -> np.ndarray:
    """The counts of the prefixes of 0, 1, … all characters."""
    steps = np.frombuffer(zlib.decompress(stored[1:]), f"<i{stored[0]}")
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


def store_prefixes(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens, prefixes) of every whole text, one narrow pass; to be written as a table."""
    bounded(df)

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            chars, tokens, packed = [], [], []
            for value in batch.column(1):
                index = tokenizer.index(value.as_py() or "")
                chars.append(len(index.text))
                tokens.append(index.total())
                packed.append(_packed(index.counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()), pa.array(packed, pa.binary())], names=[id_col, "n_chars", "n_tokens", "prefixes"])

    added = StructType.fromDDL("n_chars long, n_tokens long, prefixes binary")
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, StructType([df.schema[id_col], *added]))


def fit_budgets(stored: DataFrame, budgets: list[int], *, id_col: str = "doc_id") -> DataFrame:
    """(id, budget, fit_chars, fit_tokens): for each document and budget the longest prefix of at most so many tokens; negative budgets hold nothing."""
    wanted = [int(b) for b in budgets]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a row of output for each budget; one document's counts at a time
                counts = _unpacked(batch.column(1)[i].as_py())
                fits = [int(np.flatnonzero(counts <= b)[-1]) if b >= 0 else 0 for b in wanted]
                ids = batch.column(0).slice(i, 1).take(pa.array([0] * len(wanted), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(wanted, pa.int64()), pa.array(fits, pa.int64()), pa.array([int(counts[f]) for f in fits], pa.int64())], names=[id_col, "budget", "fit_chars", "fit_tokens"])

    added = StructType.fromDDL("budget long, fit_chars long, fit_tokens long")
    return stored.select(F.col(id_col), F.col("prefixes")).mapInArrow(run, StructType([stored.schema[id_col], *added]))


def counts_at(stored: DataFrame, chars_col: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, chars, n_tokens): the tokens of each document's first ``chars_col`` characters; beyond the end those of the whole, null and below zero none."""

    def run(batches):
        for batch in batches:
            chars, tokens = [], []
            for value, at in zip(batch.column(1), batch.column(2), strict=True):
                counts = _unpacked(value.as_py())
                chars.append(at.as_py())
                tokens.append(int(counts[min(max(at.as_py() or 0, 0), len(counts) - 1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "chars", "n_tokens"])

    added = StructType.fromDDL("chars long, n_tokens long")
    return stored.select(F.col(id_col), F.col("prefixes"), F.col(chars_col).cast("long")).mapInArrow(run, StructType([stored.schema[id_col], *added]))


__all__ = ["counts_at", "fit_budgets", "store_prefixes"]
