"""Exact line deduplication over a corpus.

Lines travel as 128-bit digests with their document and position; the text stays where it is.  The
hashes are dealt by *range* of (hash, document), so the rows of a very common line spread over several
neighbouring tasks, and each task streams its sorted rows once:

* a line's first occurrence (in the order asked for, the largest document first) is kept; the rows of
  its other documents are dropped as soon as the line turns out to be in ``min_docs`` of them;
* the first and the last line of a task may go on in its neighbours.  Their rows leave as pending, with
  one count for each task; those few counts, two a task at most, decide about the pending rows.

What returns to a document is a compressed bitmap of the lines to keep.

Null and empty texts are one empty line, an empty table gives an empty result, and a text's length matters to
nothing but the task that reads it.  A line's key is the line without ``[\\x20\\x09-\\x0D]`` at
both ends, A-Z lower-cased; keys under ``min_chars`` code points are always kept, and a key's lines
inside its one kept document all stay.

Every row is a document, in the order of the ids, of whatever type: rows without an id come before all others, and
rows that share one (repeated rows, too) follow each other in the order of their texts, so that one of them
is the largest.  Columns of the input that have the name of an added column give way to it; no other name clashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import U64, bounded, digests, fresh, lower_ascii, materialize, shuffle_partitions, signed, text_bytes, with_rows, word_bounds

_STREAMED = "kind int, h1 long, h2 long, doc long, pos int, docs long"
_DROP, _PENDING, _COUNT = 0, 1, 2


def line_keys(raw: bytes, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, position) of the lines of a text whose key has at least ``min_chars`` code points."""
    a = lower_ascii(np.frombuffer(raw, np.uint8))
    breaks = np.flatnonzero(a == 10)
    start, end = word_bounds(a)
    first = np.searchsorted(start, np.concatenate(([0], breaks + 1)))
    last = np.searchsorted(start, np.concatenate((breaks, [len(a)]))) - 1
    pos = np.flatnonzero(last >= first)
    lo, hi = start[first[pos]], end[last[pos]]
    chars = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
    long = chars[hi] - chars[lo] >= min_chars
    pos, lo, hi = pos[long], lo[long], hi[long]
    return *digests(a, lo, hi), pos


def line_hashes(rows: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc, pos) of each line of ``rows`` (doc, text) that is long enough."""

    def run(batches):
        for batch in batches:
            parts = [(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for doc, value in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), strict=True):
                h1, h2, pos = line_keys(text_bytes(value), min_chars)
                parts.append((h1, h2, np.full(len(pos), doc, np.int64), pos))
            h1, h2, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), pa.array(doc), pa.array(pos.astype(np.int32))], names=["h1", "h2", "doc", "pos"])

    return rows.mapInArrow(run, "h1 long, h2 long, doc long, pos int")


def _stream(min_docs: int):
    """One pass over a task's rows, sorted by hash and descending document."""

    def table(kind, h1, h2, doc, pos, docs):
        n = len(h1)
        cols = [np.full(n, kind, np.int32), h1, h2, doc, pos, np.full(n, 0, np.int64) if docs is None else docs]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "h1", "h2", "doc", "pos", "docs"])

    def decide(c, first_run):
        """Rows of whole runs; the first run of the task is pending."""
        h1, h2, doc, pos = c
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        heads = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        new_doc = new | np.concatenate(([True], doc[1:] != doc[:-1]))
        docs = np.bincount(run, weights=new_doc).astype(np.int64)
        drop = (docs[run] >= min_docs) & (doc != doc[heads][run])
        if first_run:
            mine = run == 0
            yield from pend([x[mine] for x in c], 0)
            drop &= ~mine
        if drop.any():
            yield table(_DROP, h1[drop], h2[drop], doc[drop], pos[drop], None)

    def pend(c, before):
        """Rows of a run that may go on elsewhere; before: the document that ended the rows before them, to count each once."""
        h1, h2, doc, pos = c
        yield table(_PENDING, h1, h2, doc, pos, None)
        n = int((np.diff(doc) != 0).sum()) + 1
        yield table(_COUNT, h1[:1], h2[:1], doc[:1], pos[:1], np.array([n - before], np.int64))

    def run(batches):
        held, first, same = None, True, None  # held: rows of the last run so far; same: (hash, last document) of a run let go as pending
        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(c[0]):
                continue
            if same is not None:  # a run too long to hold: all its rows are pending
                mine = (c[0] == same[0]) & (c[1] == same[1])
                k = int(mine.argmin()) if not mine.all() else len(mine)
                if k:
                    yield from pend([x[:k] for x in c], int(c[2][0] == same[2]))
                    same = (same[0], same[1], c[2][k - 1])
                if k == len(mine):
                    continue
                same, c, first = None, [x[k:] for x in c], False
            c = c if held is None else [np.concatenate(x) for x in zip(held, c, strict=True)]
            change = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from decide([x[:cut] for x in c], first)
                first = False
            held = [x[cut:] for x in c]
            if len(held[0]) > 100_000:
                yield from pend(held, 0)
                same, held = (held[0][0], held[1][0], held[2][-1]), None
        if held is not None:
            yield from pend(held, 0)

    return run


def dropped_lines(rows: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, pos) of the lines to drop from ``rows`` (doc, text), where ``doc`` is a long that differs in all rows."""
    bounded(rows)
    spark = rows.sparkSession
    hashes = materialize(line_hashes(rows, min_chars), "hashes")  # dealing by range reads its input twice, first for the bounds
    order = ["h1", "h2", F.col("doc").desc()]
    dealt = hashes.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    streamed = materialize(dealt.mapInArrow(_stream(min_docs), _STREAMED), "lines")
    # Two runs a task, and the few that are too long to hold, in pieces: rows in proportion to the tasks, not to the lines.
    counts = streamed.where(F.col("kind") == _COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc").alias("keep")).where(F.col("n") >= min_docs)
    pending = streamed.where(F.col("kind") == _PENDING).select("h1", "h2", "doc", "pos").join(F.broadcast(counts), ["h1", "h2"]).where(F.col("doc") != F.col("keep"))
    return streamed.where(F.col("kind") == _DROP).select("doc", "pos").unionByName(pending.select("doc", "pos"))


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Compressed keep bits of a document up to its last dropped line; the lines after it are kept."""
    keep = np.ones(int(dropped.max()) // 8 * 8 + 8, bool)  # whole bytes
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def kept_lines(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """The keep bits of all lines of a document."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(rows: DataFrame, **options) -> DataFrame:
    """(doc, bitmap) of the documents of ``rows`` (doc, text) that lose lines."""

    def pack(batches):
        for batch in batches:
            maps = [pack_bitmap(np.array(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["doc", "bitmap"])

    return dropped_lines(rows, **options).groupBy("doc").agg(F.collect_list("pos").alias("pos")).mapInArrow(pack, "doc long, bitmap binary")


def dedup_lines(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, lines_col: str = "n_lines", dropped_col: str = "n_dropped"
) -> DataFrame:
    """``df`` with the text column reduced to the kept lines, and ``lines_col`` and ``dropped_col`` (long) added."""
    bounded(df)
    df = df.drop(lines_col, dropped_col)
    names, row, bitmap = df.columns, fresh(df, "row"), fresh(df, "bitmap")
    rows, _ = with_rows(df, row, id_col=id_col, text_col=text_col, nulls_last=False)
    maps = keep_bitmaps(rows.select(F.col(row).alias("doc"), F.col(text_col).alias("text")), min_chars=min_chars, min_docs=min_docs)
    joined = rows.join(maps.select(F.col("doc").alias(row), F.col("bitmap").alias(bitmap)), row, "left").select(*names, bitmap)
    at = names.index(text_col)
    added = [lines_col, dropped_col]

    def apply(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for value, bits in zip(batch.column(at), batch.column(len(names)), strict=True):
                text = value.as_py() or ""
                parts = text.split("\n")
                keep = kept_lines(bits.as_py(), len(parts))
                lines.append(len(parts))
                dropped.append(len(parts) - int(keep.sum()))
                texts.append(text if keep.all() else "\n".join([p for p, k in zip(parts, keep.tolist(), strict=True) if k]))
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, *added])

    fields = [StructField(text_col, StringType()) if f.name == text_col else f for f in df.schema.fields]
    return joined.mapInArrow(apply, StructType([*fields, *(StructField(c, LongType()) for c in added)]))
