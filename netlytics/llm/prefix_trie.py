"""The trie of all conversations' turns: which conversations begin alike, how far, and what a shared prefix saves.

Method: turns are replaced by numbers of a dictionary of distinct (role, text).  The trie is made by distributed
most-significant-digit radix partitioning: a bucket holds the conversations below one node; each round skips the turns
that all of a bucket share, deals its conversations by the turn where they part, and emits the nodes on the way.  A bucket
with few rows is finished within one task by multikey quicksort, whose recursion emits its nodes; a bucket of one
conversation is a chain that needs no sorting.  Sums over subtrees go back up, a round at a time.

Rounds are as many as a path has partings between large buckets, not as many as it has turns.  No task holds more than
``local`` rows of a bucket; what conversations end at one node are hashed as a sorted stream.

Odd rows: rows without a conversation id are left out.  Null roles and texts are empty.  Turns are ordered by number (null
first), then by role, then by the digest of the text, so that repeated numbers and repeated rows have their places; each row is
a turn.  Texts are compared by 128 bits of their SHA-256 digests and may have any length.  An empty table has no node.
Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, shuffle_partitions

_WORD = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Buckets are told by table up to this many (a check of their number); beyond it by a join.
MAX_TOLD = 200_000

# ---------------------------------------------------------------- turns as numbers


def _places(batches):
    """The place of each row within its conversation, as far as this task's sorted rows go."""
    last, seen = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        starts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
        place = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
        if conv[0] == last:
            place[: starts[1] if len(starts) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def encode_turns(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, turn, words): each row's place in its conversation from 1 on, the number of its (role, text) and the words of its text."""
    bounded(df)
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("at"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")
    )
    rows = materialize(rows, "turns")  # texts are read once; dealing by range reads its input twice
    order = [F.col("conv"), F.col("at").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv", "digest", "words", F.spark_partition_id().alias("part"))
    placed = materialize(dealt.mapInArrow(_places, "conv long, digest binary, words long, part int, place long"), "places")
    # Only the first conversation of a task's rows can have rows in tasks before it: at most a row for each task.
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = placed.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("moved", F.sum("n").over(before)).where("moved > 0").drop("n")
    numbers = placed.groupBy("digest").agg(F.first("words").alias("words"))
    numbers = materialize(numbers.withColumn("turn", F.monotonically_increasing_id()), "dictionary")
    rows = placed.drop("words").join(F.broadcast(moved), ["conv", "part"], "left").join(numbers, "digest")
    return rows.select("conv", (F.col("place") + F.coalesce("moved", F.lit(0)) + 1).alias("pos"), "turn", "words")


def graft_heads(turns: DataFrame, *, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h = crc32(c) mod ``heads`` turns of conversation c - c % ``every`` in place of their own first h.

    Returns their rows and (conv, len), the latter also for conversations that are left without turns.
    """
    turns = materialize(turns, "encoded")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % every)
    first = turns.where(F.col("pos") < heads).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "words"))).alias("head"))  # fewer than ``heads`` each
    convs = convs.join(first, "base", "left").withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.expr("cast(array() as array<struct<pos:bigint,turn:bigint,words:bigint>>)")).otherwise(F.slice("head", F.lit(1), F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    convs = materialize(convs.withColumn("m", F.size("head").cast("long")), "heads")
    own = turns.join(convs.select("conv", "h", "m"), "conv").where(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn", "words")
    taken = convs.select("conv", F.inline("head")).select("conv", "pos", "turn", "words")
    return own.unionByName(taken), convs.select("conv", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len"))


# ---------------------------------------------------------------- buckets that one task finishes

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_LOCAL = f"{_NODE}, top boolean, pd long, pb long"


def sort_bucket(convs: list[int], turns: list[list[int]]) -> tuple[list[list], list[list[int]]]:
    """The nodes below one node, by multikey quicksort of the sequences below it; ``convs`` ascends.

    Returns nodes [parent, level, first sequence, members], the first being the node itself, parents before their children; and
    of each node the conversations that end there.
    """
    nodes, ends = [[-1, 0, 0, len(convs)]], [[]]
    stack = [(list(range(len(convs))), 0, 0)]  # (sequences, level of the symbol to compare, node they are below)
    while stack:
        rows, k, below = stack.pop()
        while len(rows) == 1:  # a chain
            i = rows[0]
            if k == len(turns[i]):
                ends[below].append(convs[i])
                break
            nodes.append([below, k + 1, i, 1])
            ends.append([])
            below, k = len(nodes) - 1, k + 1
        if len(rows) < 2:
            continue
        symbol = [turns[i][k] if k < len(turns[i]) else -1 for i in rows]
        pivot = sorted((symbol[0], symbol[len(rows) // 2], symbol[-1]))[1]
        less, more = [i for i, s in zip(rows, symbol, strict=True) if s < pivot], [i for i, s in zip(rows, symbol, strict=True) if s > pivot]
        same = [i for i, s in zip(rows, symbol, strict=True) if s == pivot]  # in order: the first has the smallest conversation
        if less:
            stack.append((less, k, below))
        if more:
            stack.append((more, k, below))
        if pivot == -1:
            ends[below] += [convs[i] for i in same]
        else:
            nodes.append([below, k + 1, same[0], len(same)])
            ends.append([])
            stack.append((same, k + 1, len(nodes) - 1))
    return nodes, ends


def _finish(c: dict[str, np.ndarray], out: dict[str, list]) -> None:
    """Adds the nodes of one bucket (rows sorted by conversation and place) to ``out``."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(c["conv"])) + 1, [len(c["conv"])])).tolist()
    turn, words, empty = c["turn"].tolist(), c["words"].tolist(), c["pos"] < 0
    spans = [(a, a if empty[a] else b) for a, b in zip(starts, starts[1:], strict=False)]
    convs = c["conv"][starts[:-1]].tolist()
    nodes, ends = sort_bucket(convs, [turn[a:b] for a, b in spans])
    children, leaves = [0] * len(nodes), [0] * len(nodes)
    saved = [(n - 1) * (words[spans[i][0] + level - 1] if level else int(c["w"][0])) for _, level, i, n in nodes]
    for j in range(len(nodes) - 1, 0, -1):
        leaves[j] = leaves[j] or 1
        up = nodes[j][0]
        children[up] += 1
        leaves[up] += leaves[j]
        saved[up] += saved[j]
    leaves[0] = leaves[0] or 1
    depth, parent = int(c["d"][0]), None if c["parent_null"][0] else int(c["parent"][0])
    out["conv_id"] += [convs[i] for _, _, i, _ in nodes]
    out["depth"] += [depth + level for _, level, _, _ in nodes]
    out["parent_conv_id"] += [convs[nodes[up][2]] if up >= 0 else parent for up, _, _, _ in nodes]
    out["n_convs"] += [n for *_, n in nodes]
    out["n_children"] += children
    out["n_leaves"] += leaves
    out["saved_tokens"] += saved
    out["ends_sha256"] += [hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest() if e else _NO_ENDS for e in ends]
    out["top"] += [True] + [False] * (len(nodes) - 1)
    out["pd"] += [int(c["pd"][0])] * len(nodes)
    out["pb"] += [int(c["pb"][0])] * len(nodes)


_ROWS = ["d", "b", "conv", "pos", "turn", "words", "w", "parent", "pd", "pb"]


def _finish_buckets(batches):
    """Nodes of the buckets in rows sorted by (d, b, conv, pos); one bucket is held at a time."""
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for f in _LOCAL.split(", ")])
    held = None

    def flush(c):
        out: dict[str, list] = {name: [] for name in schema.names}
        cuts = np.flatnonzero((np.diff(c["d"]) != 0) | (np.diff(c["b"]) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c["d"])], strict=True):
            _finish({k: v[a:b] for k, v in c.items()}, out)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {name: batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i, name in enumerate(_ROWS)}
        c["parent_null"] = batch.column(_ROWS.index("parent")).is_null().to_numpy(zero_copy_only=False)
        c = c if held is None else {k: np.concatenate((held[k], v)) for k, v in c.items()}
        last = np.flatnonzero((c["d"] != c["d"][-1]) | (c["b"] != c["b"][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield flush({k: v[:cut] for k, v in c.items()})
        held = {k: v[cut:] for k, v in c.items()}
    if held is not None:
        yield flush(held)


# ---------------------------------------------------------------- what ends at a node

_CHUNK = 8192


def _joined(batches):
    """(depth, node, first, ids): pieces of the comma-joined ids of sorted (depth, node, conv) rows."""
    for batch in batches:
        d, b, c = (batch.column(i).to_numpy() for i in range(3))
        if not len(d):
            continue
        edge = np.flatnonzero((np.diff(d) != 0) | (np.diff(b) != 0)) + 1
        starts = np.unique(np.concatenate(([0], edge, np.arange(0, len(d), _CHUNK))))
        texts = [",".join(map(str, x.tolist())) for x in np.split(c, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(d[starts]), pa.array(b[starts]), pa.array(c[starts]), pa.array(texts)], names=["depth", "node", "first", "ids"])


def _hashed(batches):
    """(depth, node, ends_sha256) of pieces sorted by (depth, node, first), as a stream."""
    key, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "node": [key[1]], "ends_sha256": [state.hexdigest()]}, schema=pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for d, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (d, b) != key:
                if key is not None:
                    yield done()
                key, state = (d, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield done()


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of rows (depth, node, conv): ids are joined piece by piece where they are sorted, and the pieces streamed through one hash a node."""
    n = shuffle_partitions(ends.sparkSession)
    pieces = ends.repartitionByRange(n, "depth", "node", "conv").sortWithinPartitions("depth", "node", "conv").mapInArrow(_joined, "depth long, node long, first long, ids string")
    return pieces.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_hashed, "depth long, node long, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, *, local: int = 4096) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv, pos, turn, words), where pos counts from 1 on without gaps in each conversation.

    ``convs`` (conv, len) lists the conversations, those without turns too (None: those of the rows).  A node is named by its
    depth and its smallest conversation ``conv_id``; see the module for what is computed.  Returns conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (SHA-256 of the ascending, comma-joined ids
    of the conversations that end there).
    """
    bounded(turns)
    spark, n = turns.sparkSession, shuffle_partitions(turns.sparkSession)
    convs = turns.groupBy("conv").agg(F.max("pos").alias("len")) if convs is None else convs
    convs = materialize(convs, "trie-convs")
    total = convs.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()
    if not total["n"]:
        return spark.createDataFrame([], _NODE)
    null = F.lit(None).cast("long")
    tops = spark.createDataFrame([(0, total["root"], total["n"], 0, None, None, None)], "d long, b long, n long, w long, parent long, pd long, pb long")
    top_columns = {"d": F.lit(0).cast("long"), "b": F.lit(total["root"]).cast("long"), "n": F.lit(total["n"]).cast("long"), "w": F.lit(0).cast("long"), "parent": null, "pd": null, "pb": null}
    rows = materialize(convs.join(turns, "conv", "left").withColumns(top_columns), "trie-rows-0")
    rounds, chains, finished, ends = [], [], [], []
    while True:
        step = len(rounds) + 1
        here = rows.select("conv", "len", "d", "b", "n", "pos", "turn", "words")
        turn_at = here.where("pos IS NOT NULL").groupBy("d", "b", "pos").agg(F.count("*").alias("c"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.min("words").alias("w"), F.min("n").alias("n"))
        turn_at = materialize(turn_at, f"trie-places-{step}")
        parts = turn_at.groupBy("d", "b").agg(F.min(F.when((F.col("c") < F.col("n")) | (F.col("lo") != F.col("hi")), F.col("pos"))).alias("f"), F.max("pos").alias("last"))
        tops = materialize(tops.join(parts, ["d", "b"], "left").withColumn("to", F.coalesce(F.col("f") - 1, "last", "d")).drop("f", "last"), f"trie-tops-{step}")
        told = tops.select("d", "b", "to")
        here = here.join(F.broadcast(told) if told.count() <= MAX_TOLD else told, ["d", "b"])
        ends.append(here.where("len = to AND (pos IS NULL OR pos = to)").select(F.col("to").alias("depth"), F.col("b").alias("node"), "conv"))
        at_parting = here.where(F.col("pos") == F.col("to") + 1)
        left = F.col("len") - F.col("pos")
        heads = at_parting.groupBy("d", "b", "pos", "turn").agg(F.count("*").alias("n"), F.min("conv").alias("node"), F.min("words").alias("w"), F.sum(left).alias("left"))
        kind = F.when(F.col("n") == 1, "chain").when(F.col("left") + F.col("n") <= local, "local").otherwise("split")
        heads = materialize(heads.withColumn("kind", kind), f"trie-heads-{step}")
        below = at_parting.select("conv", "len", "d", "b", "turn").join(heads, ["d", "b", "turn"])
        below = below.select("conv", "len", F.col("pos").alias("d"), F.col("node").alias("b"), "n", "w", F.col("b").alias("parent"), F.col("d").alias("pd"), F.col("b").alias("pb"), "kind")
        rest = here.where(F.col("pos") > F.col("to") + 1).select("conv", "pos", "turn", "words")
        dealt = materialize(below.join(rest, "conv", "left"), f"trie-rows-{step}")
        rounds.append((tops, turn_at))
        chains.append(dealt.where("kind = 'chain'"))
        bucket = dealt.where("kind = 'local'").select(*_ROWS).repartition(n, "d", "b").sortWithinPartitions("d", "b", "conv", "pos")
        finished.append(materialize(bucket.mapInArrow(_finish_buckets, _LOCAL), f"trie-local-{step}"))
        rows = dealt.where("kind = 'split'")
        tops = heads.where("kind = 'split'").select(F.col("pos").alias("d"), F.col("node").alias("b"), "n", "w", F.col("b").alias("parent"), F.col("d").alias("pd"), F.col("b").alias("pb"))
        if tops.isEmpty():
            break
    hashes = materialize(_ends_hashes(_union(ends)), "trie-ends")
    return _union([*map(_chain_nodes, chains), *(f.select(*_names()) for f in finished), *_split_nodes(rounds, chains, finished, hashes)])


def _names() -> list[str]:
    return [f.split()[0] for f in _NODE.split(", ")]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _chain_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of buckets of one conversation: the node where it parts from the others, and one for each turn after it."""
    one, conv = F.lit(1).cast("long"), F.col("conv")

    def nodes(df, depth, parent):
        last = depth == F.col("len")
        digest = F.when(last, F.sha2(conv.cast("string").cast("binary"), 256)).otherwise(F.lit(_NO_ENDS))
        return df.select(conv.alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), digest.alias("ends_sha256"))

    first = rows.where(F.col("pos").isNull() | (F.col("pos") == F.col("d") + 1))  # one row for each conversation
    return nodes(first, F.col("d"), F.col("parent")).unionByName(nodes(rows.where("pos IS NOT NULL"), F.col("pos"), conv))


def _split_nodes(rounds: list, chains: list[DataFrame], finished: list[DataFrame], hashes: DataFrame) -> list[DataFrame]:
    """Nodes of the buckets that were split, from the last round to the first; sums of subtrees go up on the way."""
    out, above = [], None
    for step in range(len(rounds) - 1, -1, -1):
        tops, turn_at = rounds[step]
        first = F.col("pos").isNull() | (F.col("pos") == F.col("d") + 1)
        sums = [chains[step].where(first).select("pd", "pb", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")), finished[step].where("top").select("pd", "pb", "n_leaves", "saved_tokens")]
        sums += [above] if above is not None else []
        below = _union(sums).groupBy(F.col("pd").alias("d"), F.col("pb").alias("b")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        tops = tops.join(below, ["d", "b"], "left").na.fill({"k": 0, "leaves": 1, "saved": 0})
        run = turn_at.select("d", "b", "pos", F.col("w").alias("run_w")).join(tops, ["d", "b"]).where(F.col("pos") <= F.col("to")).withColumn("w", F.col("run_w")).drop("run_w")
        path = tops.withColumn("pos", F.col("d")).unionByName(run)
        after = Window.partitionBy("d", "b").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
        path = path.withColumn("saved_tokens", F.col("saved") + F.sum((F.col("n") - 1) * F.col("w")).over(after))
        path = materialize(path, f"trie-path-{step}")
        above = path.where("pos = d").select("pd", "pb", F.col("leaves").alias("n_leaves"), "saved_tokens")
        nodes = path.join(hashes, (F.col("pos") == hashes["depth"]) & (F.col("b") == hashes["node"]), "left")
        out.append(nodes.select(
            F.col("b").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("d"), F.col("parent")).otherwise(F.col("b")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(F.col("pos") < F.col("to"), 1).otherwise(F.col("k")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        ))
    return out
