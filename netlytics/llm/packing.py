"""Best-fit packing of token sequences by hierarchical residual merging.

Every task tokenizes its documents once and packs its own pieces best-fit, longest first, into bins of
``capacity`` tokens.  Only piece descriptions (no ids) leave the task.  Nearly full bins are final.  An
underfull bin is an item of its own for the next level: the bins of ``fan_in`` neighbouring groups meet
in one task and are packed best-fit again, until one group is left.

What a level hands on is bounded without loss: best-fit leaves at most one bin of a group at most half
full, and only such a bin can still move into another.  Each later level thus has at most ``fan_in``
bins that move, so a group hands on its half-full bin and its ``fan_in`` emptiest other bins for each
level that is left; no more than these can ever receive one.

Documents longer than ``capacity`` are cut into pieces of ``capacity``, the first of which may be
shorter.  A null text is empty; every document ends with id ``end_id``, so none is empty as a sequence.
Repeated rows are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded, materialize

_LOADED: dict[str, object] = {}


def encoder(path: str):
    """A function text → uint32 ids of a byte-level BPE ``.json`` file, without added special tokens; strings of the file's own special tokens inside a text become those tokens."""
    if path not in _LOADED:
        from .token_counts import WORDS, load

        spec = load(path)
        ranks = {k: v for k, v in spec.vocab.items() if spec.merge(k)[0][0] == k}
        special = dict(spec.added)
        encoding = tiktoken.Encoding("corpus", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)
        _LOADED[path] = lambda text: np.array(encoding.encode(text, allowed_special=allowed, disallowed_special=()), np.uint32)
    return _LOADED[path]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item, and the fill of each bin.

    Open bins are kept by their space left, which has at most ``capacity`` values, so an item costs a
    binary search however many bins there are.
    """
    place, offset, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    spaces: list[int] = []  # the distinct spaces left, sorted
    by_space: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(spaces, n)
        if at < len(spaces):
            space = spaces[at]
            which = by_space[space].pop()
            if not by_space[space]:
                spaces.pop(at)
        else:
            space, which = capacity, len(fills)
            fills.append(0)
        place[i], offset[i] = which, fills[which]
        fills[which] += n
        left = space - n
        if left:
            if not by_space.get(left):
                by_space[left] = []
                insort(spaces, left)
            by_space[left].append(which)
    return place, offset, np.array(fills, np.int64)


def _levels(groups: int, fan_in: int) -> int:
    n = 0
    while groups > 1:
        groups, n = -(-groups // fan_in), n + 1
    return n


def _keep(fills: np.ndarray, capacity: int, receivers: int) -> np.ndarray:
    """The bins that can still be merged with one of another group."""
    half = fills * 2 <= capacity
    most = np.flatnonzero(~half & (fills < capacity))
    most = most[np.argsort(fills[most], kind="stable")][:receivers]
    return np.concatenate((np.flatnonzero(half), most))


_PIECES = "piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, fill long, open boolean, grp long"
_BIN_BITS = 32


def pack_documents(
    df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, fan_in: int = 8
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    bounded(df)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col), F.col(text_col))
    groups = max(1, source.rdd.getNumPartitions())

    receivers = fan_in * _levels(groups, fan_in)

    def first_level(batches):
        ids_of = encoder(path)
        ids, rows = [], []
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.append(ids_of(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cut = len(tokens) % capacity or capacity if len(tokens) > capacity else len(tokens)
                starts = [0, *range(cut, len(tokens), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(tokens)], strict=True)):
                    ids.append(doc.as_py())
                    rows.append((k, a, b - a, zlib.crc32(tokens[a:b].tobytes())))
        if not rows:
            return
        piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        place, offset, fills = best_fit(length, capacity)
        still = np.zeros(len(fills), bool)
        still[_keep(fills, capacity, receivers)] = True
        part = TaskContext.get().partitionId()
        cols = [pa.array(ids, kinds), pa.array(piece.astype(np.int32)), *(pa.array(x) for x in (start, length, crc, (part << _BIN_BITS) + place, offset, fills[place], still[place], np.full(len(place), part)))]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "fill", "open", "grp"]
    kinds = to_arrow_type(df.schema[id_col].dataType)
    pieces = materialize(source.mapInArrow(first_level, f"`{id_col}` {kind}, {_PIECES}"), "pieces")

    bins = pieces.where("open").select("bin", "fill", "grp").distinct()
    moved, level = None, 0
    while groups > 1:
        level += 1
        bins = materialize(_merge_level(bins, capacity, fan_in, fan_in * _levels(-(-groups // fan_in), fan_in)), f"level{level}")
        step = bins.where(F.col("into").isNotNull()).select(F.col("bin").alias("from_bin"), "into", "shift")
        moved = step if moved is None else _follow(moved, step)
        groups = -(-groups // fan_in)
        bins = bins.where("open").select("bin", F.col("new_fill").alias("fill"), "grp")
    if moved is None:
        out = pieces.withColumns({"sequence_id": F.col("bin"), "offset": F.col("bin_offset")})
    else:  # at most one bin of each first group moves: a row for each task, whatever the data
        out = pieces.join(F.broadcast(moved), F.col("bin") == F.col("from_bin"), "left").withColumns(
            {"sequence_id": F.coalesce("into", "bin"), "offset": F.col("bin_offset") + F.coalesce("shift", F.lit(0))}
        )
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _merge_level(bins: DataFrame, capacity: int, fan_in: int, receivers: int) -> DataFrame:
    """Best-fit of the groups' bins, ``fan_in`` groups together: where each bin goes (into null: it stays), and the bins that are still open."""

    def merge(key, table):
        bin_ids, fills = table.column("bin").to_numpy(), table.column("fill").to_numpy()
        order = np.lexsort((bin_ids, -fills))
        bin_ids, fills = bin_ids[order], fills[order]
        place, offset, total = best_fit(fills, capacity)
        _, heads = np.unique(place, return_index=True)  # in each new bin, the first item stays where it is
        host = bin_ids[heads][place]
        stays = host == bin_ids
        keep = np.zeros(len(total), bool)
        keep[_keep(total, capacity, receivers)] = True
        return pa.table(
            {
                "bin": bin_ids,
                "into": pa.array(host, mask=stays),
                "shift": offset,
                "new_fill": total[place],
                "open": stays & keep[place],
                "grp": np.full(len(bin_ids), key[0].as_py()),
            }
        )

    return bins.withColumn("grp", F.floor(F.col("grp") / fan_in)).groupBy("grp").applyInArrow(merge, "bin long, into long, shift long, new_fill long, open boolean, grp long")


def _follow(moved: DataFrame, step: DataFrame) -> DataFrame:
    """Moves of earlier levels carried on through the moves of this one."""
    s = step.select(F.col("from_bin").alias("host"), F.col("into").alias("next"), F.col("shift").alias("more"))
    on = moved.join(s, moved["into"] == F.col("host"), "left")
    return on.select("from_bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).unionByName(step)
