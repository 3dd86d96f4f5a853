"""Spelling variants: words one edit apart, each pointed to a much more frequent near word.

Method: the vocabulary is a trie, joined with itself by active nodes: a node's active nodes are those whose prefixes are within
one edit of its own.  They are propagated down, level by level, and pairs of words at distance one come out where both nodes
are terminal.  The trie is partitioned by prefix.  Above the partition level, a node pair at distance one has no edit left, so
both can only follow the same rest of the word: they meet by name, which is the word without the character in
question.  Below it, each task holds whole subtries and propagates the active nodes of a level at a time.  A prefix with too
many words is split by its next character, which moves that level from the subtrie to the meeting by name.

An insertion is ascribed to the first of a run of equal characters, so every pair comes out once.  Words meet by name in groups
that differ in one character only; a group gives each member the count of the others and the best of them, so no pairs are
written.  Subtries are split down to ``local`` words, unless words are too short to part them.

Odd rows: null and empty texts have no words; words may have any length; every row is a document, and an absent id counts
as an empty one where ids are hashed.  Other columns are ignored, so their names cannot clash.
An empty table has no words.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, shuffle_partitions

#: Letters of words: ASCII letters and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_HELD = 200_000

# ---------------------------------------------------------------- words of documents


def count_words(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None, min_chars: int = 1, min_count: int = 1) -> DataFrame:
    """(word, n): the words of at least ``min_chars`` code points that occur at least ``min_count`` times, A-Z in lower case.

    ``drop_every``: a word of whose hash with its document's id this is a divisor loses one character there, by the
    hash: known misspellings, with which the grouping can be measured.  Words are counted in each document, in each task, and then overall.
    """
    bounded(df)
    pattern = regex.compile(LETTERS)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found: Counter = Counter(pattern.findall(text.translate(_ASCII_LOWER)))
                head = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in found.items():
                    if drop_every:
                        h = zlib.crc32(word.encode(), head)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= min_chars:
                        total[word] += n
            if len(total) >= _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                total.clear()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    words = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- subtries


def near_words(words: list[str], depth: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart, by active nodes of the subtries of ``words``.

    Words are sorted by (group, word) and differ within a group; the words of a group share their first ``depth`` characters, and only edits
    from there on are sought.  A node of level d is a run of words with equal group and first d characters; a node's active nodes
    at distance one are kept as pairs of nodes of levels (d, d) or (d, d + 1).
    """
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbols = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    depth = np.minimum(depth, size)
    left, below = size - depth, np.cumsum(size) - size + depth  # characters below the top of its subtrie, and where they begin
    none = np.zeros(0, np.int64)
    found_a, found_b = [none], [none]
    node = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))  # of each word at the present level, words that have ended included
    first = below[np.concatenate(([True], node[1:] != node[:-1]))]
    last = np.where(depth[np.concatenate(([True], node[1:] != node[:-1]))] > 0, symbols[np.maximum(first, 1) - 1], -1)  # the character before, by node
    word = np.arange(len(words))  # with a node at this level
    same_a = same_b = longer_a = longer_b = none  # active: (d, d) and (d, d + 1), as nodes of levels d, d and d, d + 1
    for d in range(int(left.max()) + 1):
        # Words that end here: terminal nodes.
        ended = np.full(int(node.max(initial=-1)) + 1, -1)
        shared = np.bincount(node) > 1
        if not (len(same_a) or len(longer_a) or shared.any()):
            break
        over = left[word] == d
        ended[node[over]] = word[over]
        # Children of the nodes, one for each next character.
        go = word[~over]
        if not len(go):
            hit = (ended[same_a] >= 0) & (ended[same_b] >= 0)
            found_a.append(ended[same_a[hit]])
            found_b.append(ended[same_b[hit]])
            break
        parent, symbol = node[~over], symbols[below[go] + d]
        first = np.concatenate(([True], (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])))
        child = np.cumsum(first) - 1
        up, by = parent[first], symbol[first]  # of each child its node and character, in order
        begin = np.searchsorted(up, np.arange(len(ended) + 1))
        next_ended = np.full(len(up), -1)
        ends_next = left[go] == d + 1
        next_ended[child[ends_next]] = go[ends_next]
        # Pairs that end: both terminal.
        hit = (ended[same_a] >= 0) & (ended[same_b] >= 0)
        found_a.append(ended[same_a[hit]])
        found_b.append(ended[same_b[hit]])
        # New pairs from a node itself (distance 0): two of its children (a replaced character), and the node with a child (an inserted one), unless it repeats the character before.
        # A node of one word has no pair within itself.
        fan = begin[1:] - begin[:-1]
        later = begin[up + 1] - np.arange(len(up)) - 1
        a = np.repeat(np.arange(len(up)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        fresh = (by != last[up]) & shared[up]
        new_a, new_b = up[fresh], np.flatnonzero(fresh)
        # Longer pairs of this level: from the level before, plus the new ones.
        longer_a, longer_b = np.concatenate((longer_a, new_a)), np.concatenate((longer_b, new_b))
        hit = (ended[longer_a] >= 0) & (next_ended[longer_b] >= 0)
        found_a.append(ended[longer_a[hit]])
        found_b.append(next_ended[longer_b[hit]])
        # Down by equal characters: children of both nodes of a pair.
        key = up * (1 << 21) + by
        pair = np.repeat(np.arange(len(same_a)), fan[same_a])
        c = begin[same_a[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(fan[same_a]) - fan[same_a], fan[same_a])
        want = same_b[pair] * (1 << 21) + by[c]
        other = np.minimum(np.searchsorted(key, want), len(key) - 1)
        match = key[other] == want
        same_a, same_b = np.concatenate((c[match], a)), np.concatenate((other[match], b))
        # The longer node's children are of the level after the next: they are numbered as that level will be.
        deep = left[go] > d + 1
        gp, gs = child[deep], symbols[below[go[deep]] + d + 1]
        begins = np.concatenate(([True], (gp[1:] != gp[:-1]) | (gs[1:] != gs[:-1]))) if len(gp) else np.zeros(0, bool)
        deep_key = gp[begins] * (1 << 21) + gs[begins]
        pair = np.repeat(np.arange(len(longer_a)), fan[longer_a])
        c = begin[longer_a[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(fan[longer_a]) - fan[longer_a], fan[longer_a])
        want = longer_b[pair] * (1 << 21) + by[c]
        if len(deep_key):
            other = np.minimum(np.searchsorted(deep_key, want), len(deep_key) - 1)
            match = deep_key[other] == want
            longer_a, longer_b = c[match], other[match]
        else:
            longer_a = longer_b = none
        node, word, last = child, go, by
    return np.concatenate(found_a), np.concatenate(found_b)


_BEST = "word string, n_near long, best_n long, best string"


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each word of the pairs: its near words and the most frequent of them, the first in code-point order among equals."""
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    of, near = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((place[near], -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(of)))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in of[first]], pa.string()), pa.array(counts, pa.int64()), pa.array(n[near[first]], pa.int64()), pa.array([words[i] for i in near[first]], pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def _join_subtries(local: int):
    """Near words within the subtries of rows (depth, prefix, word, n) sorted by (prefix, depth, word), whole subtries at a time."""

    def flush(rows):
        depth, prefix, words, n = rows
        change = [0] + [int(x != y) for x, y in zip(prefix[1:], prefix, strict=False)]
        group = np.cumsum(change)
        a, b = near_words(words, np.array(depth, np.int64), group)
        return _best(words, np.array(n, np.int64), a, b)

    def run(batches):
        held = [[], [], [], []]
        for batch in batches:
            for column, values in zip(held, batch.columns, strict=True):
                column += values.to_pylist()
            if len(held[0]) < 4 * local:
                continue
            cut = len(held[0])
            while cut and held[1][cut - 1] == held[1][-1]:
                cut -= 1
            if cut:
                yield flush([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held[0]:
            yield flush(held)

    return run


# ---------------------------------------------------------------- partitions of the trie


def _partition(words: DataFrame, local: int, first: int) -> DataFrame:
    """``words`` with ``depth``: the length of the prefix of each word's subtrie, so that subtries have at most ``local`` words, or only words as long as their prefix."""
    done, depth, live = None, first, words.withColumn("depth", F.lit(first))
    while True:
        live = materialize(live.withColumn("prefix", F.substring("word", 1, depth)), f"words-{depth}")
        large = live.groupBy("prefix").agg(F.count("*").alias("words"), F.max(F.length("word")).alias("longest")).where((F.col("words") > local) & (F.col("longest") > depth))
        large = materialize(large.select("prefix"), f"large-{depth}")
        small = live.join(large, "prefix", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        depth += 1
        live = live.join(large, "prefix", "left_semi").withColumn("depth", F.lit(depth))


def _met_above(words: DataFrame) -> DataFrame:
    """For each word of ``words`` (word, n, depth) its near words by an edit above its subtrie's top: (word, n_near, best_n, best).

    Node pairs at distance one meet by name: the position and the word without its character there (of a run of equal ones the first), and the
    word itself for those that have one character more.  A group's members differ only in that character.
    """
    i = F.expr("explode(sequence(0, depth - 1))")
    at = words.select("word", "n", "depth", i.alias("i")).where(F.col("i") <= F.length("word"))
    cut = F.concat(F.expr("substring(word, 1, i)"), F.expr("substring(word, i + 2)"))
    whole = at.select("i", F.col("word").alias("name"), "word", "n", F.lit(True).alias("whole"), F.lit(True).alias("first"))
    dropped = at.where(F.col("i") < F.length("word")).select("i", cut.alias("name"), "word", "n", F.lit(False).alias("whole"), ((F.col("i") == 0) | (F.expr("substring(word, i + 1, 1)") != F.expr("substring(word, i, 1)"))).alias("first"))
    met = whole.unionByName(dropped)
    # Those that drop a character are all near each other; the whole word is near those that drop the first of a run.
    drops, inserts = ~F.col("whole"), ~F.col("whole") & F.col("first")
    rank = F.struct((-F.col("n")).alias("m"), "word")
    groups = met.groupBy("i", "name").agg(
        F.array_sort(F.collect_list(F.when(drops, F.struct((-F.col("n")).alias("m"), "word", "first")))).alias("members"),  # as many as there are letters at most
        F.count(F.when(inserts, 1)).alias("inserted"), F.min(F.when(inserts, rank)).alias("best_inserted"), F.min(F.when(F.col("whole"), rank)).alias("shorter"),
    ).where("size(members) + cast(shorter IS NOT NULL AS int) > 1")
    each = groups.select("*", F.explode("members").alias("me"))
    other = F.when(F.expr("members[0].word = me.word"), F.expr("get(members, 1)")).otherwise(F.expr("members[0]"))
    shorter = F.when(F.col("me.first"), F.col("shorter"))
    each = each.select(F.col("me.word").alias("word"), (F.size("members") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("n_near"), F.when(other.isNotNull(), F.struct(other["m"].alias("m"), other["word"].alias("word"))).alias("other"), shorter.alias("shorter"))
    each = each.where("n_near > 0").select("word", "n_near", F.least("other", "shorter").alias("best"))  # least passes over nulls
    wholes = groups.where("inserted > 0 AND shorter IS NOT NULL").select("shorter.word", F.col("inserted").alias("n_near"), F.col("best_inserted").alias("best"))
    return each.unionByName(wholes).select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.word").alias("best"))


def near_counts(words: DataFrame, *, local: int = 4096, first: int = 2) -> DataFrame:
    """``words`` (word, n; each word once, none empty) with n_near, and best and best_n: the most frequent word at distance one, the first in code-point order among equals."""
    bounded(words)
    parted = materialize(_partition(words, local, first).select("word", "n", "depth", "prefix"), "subtries")
    n = shuffle_partitions(words.sparkSession)
    dealt = parted.select("depth", "prefix", "word", "n").repartition(n, "prefix", "depth").sortWithinPartitions("prefix", "depth", "word")
    near = dealt.mapInArrow(_join_subtries(local), _BEST).unionByName(_met_above(parted))
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b"))
    best = best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.word").alias("best"))
    return parted.select("word", "n").join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def group_variants(words: DataFrame, *, ratio: float = 2, local: int = 4096, first: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's most frequent near word if that occurs at least ``ratio`` (over 1) times as often, and the word that forms lead to.

    Forms grow in frequency, so they cannot lead in a circle; each round doubles how far a word has followed them.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    near = near_counts(words, local=local, first=first)
    is_form = F.col("best_n") >= F.col("n") * ratio
    rows = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    ways, step = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:  # words without a form are not in ways, and end them
        step += 1
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = materialize(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{step}")
        if ways.where("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return rows.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
