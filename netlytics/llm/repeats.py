"""Removal of long repeated byte strings with run-length indexes.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the corpus.

1. *Meeting places.*  In every window of ``length`` bytes the ``gram``-byte substring with the smallest
   hash (the leftmost one) is the window's anchor.  Equal windows have equal anchors at equal places, so windows only need comparing where
   anchors meet.  Neighbouring windows share anchors: a row stands for a stretch of window starts, with
   its anchor's hash and the digest of its whole context (first to last byte of its windows).
2. Rows are dealt by range of (anchor, context, place), so that a very common one spreads, and streamed once.  An anchor met once ends there.
   Contexts met twice repeat as a whole: equal texts are one text to the index.  The other contexts of anchors met several times are open.
3. Documents cut out their open contexts, and one copy of each whole repeat beside them.  Contexts of
   the same anchor go to the same bucket, and each bucket builds a run-length index over its contexts: the
   runs of the Burrows-Wheeler transform, with the places in the text of each run's first and last row.  All contexts are then streamed
   against it, backwards and side by side.  A context's match with the rows above and below its own grows by one with each step
   inside a run, and is measured anew at a run's end, from the sampled places.  Starts with ``length`` or more are repeated.
4. An anchor with more than ``hot`` open contexts is not put into one bucket.  The digests of its
   windows are counted instead, dealt by digest with a partial count in each task.

Null texts are empty, an empty table gives an empty result, a text's length has no bound; matches never cross documents.
Equality in steps 2 and 4 is that of 128-bit digests.  Every row is a document: ids may be of any type, absent or shared, and repeated rows
are copies of each other.  Only the id and text columns are looked at, so no other name clashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import FULL, U64, bounded, digests, fresh, gram_hashes, materialize, shuffle_partitions, text_bytes, with_rows


def slide_min(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimum of each window of ``w`` values, without its low bits, and its leftmost position.

    A window lies over two blocks of ``w`` values: it is the end of one and the start of the next.
    """
    n = len(g)
    low = U64((1 << (2 * w).bit_length()) - 1)
    x = np.full(-(-n // w) * w, FULL)
    x[:n] = g
    x = x.reshape(-1, w) & ~low
    within = np.arange(w, dtype=U64)
    right = np.minimum.accumulate(x | (within + U64(w)), 1).ravel()
    left = np.minimum.accumulate((x | within)[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(left[: n - w + 1], right[w - 1 : n])
    return least & ~low, np.arange(n - w + 1) // w * w + (least & low).astype(np.int64)


def anchors(raw: bytes, length: int, gram: int):
    """(anchor, two halves of the context's digest, first start, end of starts) of each stretch of windows with one anchor."""
    a = np.frombuffer(raw, np.uint8)
    if len(a) < length:
        return None
    least, place = slide_min(gram_hashes(a, gram), length - gram + 1)
    lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    hi = np.concatenate((lo[1:], [len(least)]))
    return least[lo], *digests(raw, lo, hi - 1 + length), lo, hi


def _stretches(length: int, gram: int):
    def run(batches):
        for batch in batches:
            parts = [(np.zeros(0, U64),) * 3 + (np.zeros(0, np.int64),) * 3]
            for doc, value in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), strict=True):
                found = anchors(text_bytes(value), length, gram)
                if found:
                    parts.append((*found, np.full(len(found[0]), doc, np.int64)))
            h, c1, c2, lo, hi, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h, c1, c2)] + [pa.array(doc), pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int32))], names=["h", "c1", "c2", "doc", "lo", "n"])

    return run


_WHOLE, _OPEN, _EDGE, _HOT = 0, 1, 2, 3
_MET = "kind int, h long, c1 long, c2 long, doc long, lo int, n int, copies int"


def _meet(hot: int):
    """From rows sorted by (h, c1, c2): whole repeats and open contexts of anchors that meet.

    The first copy of a whole repeat is marked as open, too, if its anchor has open contexts: it is the
    text that these may match.  Anchors with more than ``hot`` open contexts are marked so.  A task's first and last anchor, and anchors with too many rows to
    hold, may go on in other tasks: one row for each of their contexts leaves as an edge, with the number of
    its copies here, to be decided by the sum over all tasks.
    """

    def out(kind, c, copies=None):
        n = len(c[0])
        kinds = np.full(n, kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32)
        last = np.ones(n, np.int32) if copies is None else copies.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, c), pa.array(last)], names=["kind", "h", "c1", "c2", "doc", "lo", "n", "copies"])

    def edge(c):
        new = np.ones(len(c[0]), bool)
        new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
        of_c = np.cumsum(new) - 1
        copies = np.bincount(of_c)
        whole = copies[of_c] > 1
        if whole.any():
            yield out(_WHOLE, [x[whole] for x in c])
        yield out(_EDGE, [x[new] for x in c], copies)

    def run(batches):
        held, first, same = None, True, None
        for batch in batches:
            c = [x.to_numpy() for x in batch.columns[:6]]
            if not len(c[0]):
                continue
            if same is not None:
                k = int(np.searchsorted(c[0], same, side="right"))
                if k:
                    yield from edge([x[:k] for x in c])
                if k == len(c[0]):
                    continue
                c, same = [x[k:] for x in c], None
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            cut = int(np.searchsorted(c[0], c[0][-1]))
            if cut:
                w = [x[:cut] for x in c]
                if first:
                    k = int(np.searchsorted(w[0], w[0][0], side="right"))
                    yield from edge([x[:k] for x in w])
                    w, first = [x[k:] for x in w], False
                if len(w[0]):
                    new_h = np.concatenate(([True], w[0][1:] != w[0][:-1]))
                    new_c = new_h | np.concatenate(([True], (w[1][1:] != w[1][:-1]) | (w[2][1:] != w[2][:-1])))
                    of_h, of_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
                    whole = np.bincount(of_c)[of_c] > 1
                    if whole.any():
                        yield out(_WHOLE, [x[whole] for x in w])
                    some_open = np.bincount(of_h, weights=~whole)[of_h] > 0
                    show = (np.bincount(of_h)[of_h] > 1) & some_open & (~whole | new_c)
                    if show.any():
                        many = np.bincount(of_h, weights=show)[of_h] > hot
                        yield out(np.where(many, _HOT, _OPEN)[show], [x[show] for x in w])
            held = [x[cut:] for x in c]
            if len(held[0]) > 100_000:
                yield from edge(held)
                same, held, first = held[0][0], None, False
        if held is not None:
            yield from edge(held)

    return run


def _edges(met: DataFrame, hot: int) -> DataFrame:
    """The edge rows of ``_meet`` decided by counts over all tasks, in the same form.

    ``totals`` has two anchors for each task and those with over 100,000 rows in a task: in proportion to the tasks.
    """
    rows = met.where(F.col("kind") == _EDGE)
    names = ["h", "c1", "c2", "doc", "lo", "n"]
    contexts = rows.groupBy("h", "c1", "c2").agg(F.sum("copies").alias("met"), F.min(F.struct("doc", "lo")).alias("one"))
    totals = contexts.groupBy("h").agg(F.sum("met").alias("all"), F.sum((F.col("met") == 1).cast("long")).alias("single"), F.count("*").alias("shown"))
    known = rows.select(*names).join(contexts, ["h", "c1", "c2"]).join(F.broadcast(totals), "h").where("all > 1")
    whole = known.where("met > 1").select(F.lit(_WHOLE).alias("kind"), *names)
    kind = F.when(F.col("shown") > hot, F.lit(_HOT)).otherwise(F.lit(_OPEN))
    shown = known.where((F.col("single") > 0) & (F.struct("doc", "lo") == F.col("one"))).select(kind.alias("kind"), *names)
    return whole.unionByName(shown)


# ---------------------------------------------------------------- the run-length index


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of byte strings, with the text places of all run ends.

    Kept are, for each run: its symbol, its first row, the row that its first row maps to, the places in the text of its first and last row, and the
    nearest runs of the same symbol on both sides.  The suffix array that they are made from is not kept.
    """

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts])
        self.ends = np.cumsum(size + 1)  # one past each separator
        self.starts = self.ends - size - 1
        n = int(self.ends[-1])
        self.symbols = np.zeros(n, np.int16)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        inside = np.ones(n, bool)
        inside[self.ends - 1] = False
        self.symbols[inside] = flat.astype(np.int16) + 1
        self.left = np.repeat(self.ends - 1, size + 1) - np.arange(n)  # bytes up to the separator
        self._compress(self._sort())

    def _compress(self, order: np.ndarray) -> None:
        n = len(order)
        before = self.symbols[order - 1]  # the transform; the first text's start wraps around to a separator
        new = np.ones(n, bool)
        new[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # separators are all different
        self.head = np.flatnonzero(new)
        tail = np.concatenate((self.head[1:], [n])) - 1
        self.symbol, length = before[self.head], tail - self.head + 1
        self.at_head, self.at_tail = order[self.head], order[tail]
        runs = np.argsort(self.symbol, kind="stable")
        by_symbol = self.symbol[runs]
        self.maps_to = np.empty(len(runs), np.int64)
        self.maps_to[runs] = np.cumsum(length[runs]) - length[runs]
        self.above, self.below = np.full(len(runs), -1), np.full(len(runs), -1)  # runs of the same symbol
        twin = (by_symbol[1:] == by_symbol[:-1]) & (by_symbol[1:] > 0)
        self.above[runs[1:][twin]], self.below[runs[:-1][twin]] = runs[:-1][twin], runs[1:][twin]
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.last_row = row[self.ends - 1]  # of each text's separator

    def run_of(self, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.head, row, side="right") - 1

    def _sort(self) -> np.ndarray:
        """The suffix array by prefix doubling.  A suffix ends at its separator; separators are in the order of their places."""
        n = len(self.symbols)
        packed, h = np.zeros(n, np.int64), 6
        for i in range(h):  # six symbols at once, to begin with
            packed *= 257
            packed[: max(0, n - i)] += np.where(self.left[: max(0, n - i)] >= i, self.symbols[i:], 0)
        order = np.argsort(packed, kind="stable")
        key = packed[order]
        while True:
            new = np.concatenate(([True], key[1:] != key[:-1])) | (self.left[order] < h)
            if new.all():
                return order
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            tied = ~(new & np.concatenate((new[1:], [True])))  # suffixes whose place is still open: none has met its separator
            at = order[tied]
            sub = (rank[at] << 32) | rank[at + h]
            place = np.argsort(sub, kind="stable")
            at, sub = at[place], sub[place]
            order[tied] = at
            key = rank[order] << 32
            key[tied] = sub
            h *= 2

    def longest_elsewhere(self) -> np.ndarray:
        """For each position the length of its longest match with another one, within the strings.

        The matching statistics of all strings, streamed backwards and side by side.  A string's row goes from the row of its
        separator through the transform.  The rows above and below it go with it while they are in the same run, and
        match one byte more.  At a run's end the next run of the same symbol has the new neighbour: its sampled place
        says where in the text to measure the match.
        """
        best = np.zeros(len(self.symbols), np.int64)
        at, row = self.ends - 1, self.last_row
        up, down = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while True:
            run = self.run_of(row)
            go = self.symbol[run] > 0
            if not go.all():
                at, row, run, up, down = at[go], row[go], run[go], up[go], down[go]
            if not len(at):
                return np.minimum(best, self.left)
            at = at - 1
            inside = row > self.head[run]
            up = self._neighbour(at, np.where(inside, up + 1, 0), ~inside, self.above[run], self.at_tail)
            inside = row < np.append(self.head[1:], len(self.symbols))[run] - 1
            down = self._neighbour(at, np.where(inside, down + 1, 0), ~inside, self.below[run], self.at_head)
            row = self.maps_to[run] + row - self.head[run]
            best[at] = np.maximum(up, down)

    def _neighbour(self, at, match, ends, other, sample):
        """The match with the neighbouring row: where a run ends, it is measured from the sample of the next run of the symbol, if there is one."""
        new = np.flatnonzero(ends & (other >= 0))
        if len(new):
            match[new] = self._match(at[new], sample[other[new]] - 1)
        return match

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of pairs of suffixes, up to their separators."""
        most = np.minimum(self.left[a], self.left[b])
        done, step = np.zeros(len(a), np.int64), 8
        live = np.arange(len(a))
        while len(live):
            offset = done[live, None] + np.arange(step)
            ok = offset < most[live, None]
            x = self.symbols[np.where(ok, a[live, None] + offset, 0)]
            y = self.symbols[np.where(ok, b[live, None] + offset, 0)]
            same = ok & (x == y)
            run = np.where(same.all(1), step, same.argmin(1))
            done[live] += run
            live = live[run == step]
            step = min(64, step * 2)
        return done


def repeated_starts(contexts: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each (bytes, number of window starts) the starts whose window is also in another place."""
    index = RunLengthIndex([c for c, _ in contexts])
    best = index.longest_elsewhere()
    return [np.flatnonzero(best[s : s + n] >= length) for s, (_, n) in zip(index.starts.tolist(), contexts, strict=True)]


def _cut(names: str):
    """The contexts of documents' open rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, value, items in zip(*batch.columns, strict=True):
                raw = bytes(text_bytes(value))
                doc = doc.as_py()
                for x in items.as_py():
                    rows.append((x["h"], doc, x["lo"], x["n"], x["hot"], raw[x["lo"] : x["lo"] + x["n"] + x["more"]]))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=names.split())

    return run


def _index_bucket(length: int, most_bytes: int):
    """(doc, lo, n) stretches of repeated starts; rows sorted by bucket and anchor, taken in portions of whole anchors."""

    def solve(rows):
        found = repeated_starts([(c, n) for _, _, n, c in rows], length)
        doc, lo = [], []
        for (d, at, _, _), starts in zip(rows, found, strict=True):
            doc.append(np.full(len(starts), d, np.int64))
            lo.append(starts + at)
        return _runs(np.concatenate(doc), np.concatenate(lo))

    def run(batches):
        rows, size, anchor = [], 0, None
        for batch in batches:
            for h, doc, lo, n, c in zip(*(batch.column(x).to_pylist() for x in ("h", "doc", "lo", "n", "context")), strict=True):
                if h != anchor and size >= most_bytes:
                    yield solve(rows)
                    rows, size = [], 0
                anchor = h
                rows.append((doc, lo, n, c))
                size += len(c) + 1
        if rows:
            yield solve(rows)

    return run


def _runs(doc: np.ndarray, lo: np.ndarray):
    """Neighbouring starts of a document as stretches."""
    order = np.lexsort((lo, doc))
    doc, lo = doc[order], lo[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + 1)
    head = np.flatnonzero(new)
    tail = (np.concatenate((head[1:], [len(doc)])) - 1)[: len(head)].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(lo[head].astype(np.int32)), pa.array((lo[tail] - lo[head] + 1).astype(np.int32))], names=["doc", "lo", "n"])


def _window_hashes(length: int):
    def run(batches):
        for batch in batches:
            parts = [(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for doc, lo, n, c in zip(*(batch.column(x).to_pylist() for x in ("doc", "lo", "n", "context")), strict=True):
                at = np.arange(n)
                parts.append((*digests(c, at, at + length), np.full(n, doc, np.int64), at + lo))
            w1, w2, doc, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32))], names=["w1", "w2", "doc", "lo"])

    return run


def repeated_stretches(docs: DataFrame, *, length: int, gram: int, hot: int, bucket_bytes: int) -> DataFrame:
    """(doc, lo, n): stretches of starts of repeated strings of ``length`` bytes in rows (doc, text), where ``doc`` is a long that differs in all rows."""
    spark = docs.sparkSession
    order = ["h", "c1", "c2", "doc", "lo"]
    rows = docs.mapInArrow(_stretches(length, gram), "h long, c1 long, c2 long, doc long, lo int, n int")
    met = materialize(rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_meet(hot), _MET), "met")
    met = met.where(F.col("kind") != _EDGE).drop("copies").unionByName(_edges(met, hot))
    whole = met.where(F.col("kind") == _WHOLE).select("doc", "lo", "n")

    item = F.struct("h", "lo", "n", F.lit(length - 1).alias("more"), (F.col("kind") == _HOT).alias("hot"))
    by_doc = met.where(F.col("kind").isin(_OPEN, _HOT)).groupBy("doc").agg(F.collect_list(item).alias("items"))
    names = "h doc lo n hot context"
    contexts = docs.join(by_doc, "doc").select("doc", "text", "items").mapInArrow(_cut(names), "h long, doc long, lo int, n int, hot boolean, context binary")
    contexts = materialize(contexts, "contexts")
    n_buckets = shuffle_partitions(spark)
    dealt = contexts.where("NOT hot").select("h", "doc", "lo", "n", "context").repartition(n_buckets, "h").sortWithinPartitions("h", "doc", "lo")
    found = dealt.mapInArrow(_index_bucket(length, bucket_bytes), "doc long, lo int, n int")
    windows = contexts.where("hot").mapInArrow(_window_hashes(length), "w1 long, w2 long, doc long, lo int")
    several = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    found_hot = windows.join(several, ["w1", "w2"]).select("doc", "lo", F.lit(1).alias("n"))
    return whole.unionByName(found).unionByName(found_hot)


def _removed(stretches: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [start, end) from stretches (first start, number of starts)."""
    out: list[list[int]] = []
    for lo, n in sorted(stretches):
        end = min(size, lo + n - 1 + length)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


def remove_repeats(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, hot: int = 4096, bucket_bytes: int = 1 << 21
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept): what is left of each text's UTF-8 bytes, and the removed runs."""
    bounded(df)
    gram = gram or max(1, length // 2)
    df = df.select(id_col, text_col)
    row = fresh(df, "row")
    rows, _ = with_rows(df, row, id_col=id_col, text_col=text_col)
    docs = rows.select(F.col(row).alias("doc"), F.col(text_col).alias("text"))
    stretches = repeated_stretches(docs, length=length, gram=gram, hot=hot, bucket_bytes=bucket_bytes)
    stretches = stretches.groupBy("doc").agg(F.collect_list("lo").alias("__lo"), F.collect_list("n").alias("__n")).withColumnRenamed("doc", row)
    joined = rows.join(stretches, row, "left").select(id_col, text_col, "__lo", "__n")

    def apply(batches):
        for batch in batches:
            n_bytes, removed, runs, kept = [], [], [], []
            for value, lo, n in zip(*batch.columns[1:], strict=True):
                raw = bytes(text_bytes(value))
                gone = _removed(list(zip(lo.as_py(), n.as_py(), strict=True)), length, len(raw)) if lo.is_valid else []
                n_bytes.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                runs.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *(x for run in gone for x in run), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    added = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
    return joined.mapInArrow(apply, StructType([df.schema[id_col], *added]))
