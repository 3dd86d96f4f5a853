"""Conversations without quotations, in reply order.

Quoted lines begin with ``>`` (nested: ``>>``, ``> >``).  A quoted passage is a run of lines of one level;
lines are normalised (markers off, white space single, A-Z lower-cased), and empty ones do not count.
The whole passage is hashed and looked up among all runs of as many lines that earlier messages of the
conversation wrote themselves: the latest earlier message with the run is the original of all its lines.
Only in a passage without such a message, each line is looked up alone, in the same way.  A message replies
to the original of most of its level-1 lines (the latest of equals); without a linked quotation it follows
the message before it.  Originals are always earlier, so the order of turns puts every reply after what it
replies to.

The look-up is one ordered pass for each (conversation, passage) and (conversation, line): an original is carried forward to the
quotations after it, so a line that very many messages share costs no pairs.  Lines that nobody quotes
are dropped before it.

Rows without a conversation or a turn are left out.  Of rows with the same conversation and turn each stays, and all are
one message to link to.  Null texts are empty.  Own lines keep their order; lines of quotations go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

_MARKS = r"^[ \t]*((?:>[ \t]*)+)"


def quoted_lines(df: DataFrame, text: str = "text"):
    """(…, place, level, line, key): the lines of messages with their quote level and normalised form."""
    lines = df.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("place", "raw")).drop(text)
    marks = F.regexp_extract("raw", _MARKS, 1)
    level = F.length(F.regexp_replace(marks, r"[ \t]", ""))
    line = F.regexp_replace("raw", _MARKS, "")
    key = F.translate(F.btrim(F.regexp_replace(line, r"[ \t\x0B\f]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lines.select("*", level.alias("level"), line.alias("line"), key.alias("key")).drop("raw")


def _hashes(of):
    return F.xxhash64(of).alias("h1"), F.xxhash64(F.lit(1), of).alias("h2")


def _runs(rows: DataFrame) -> DataFrame:
    """(conv, turn, level, lines): the runs of lines of one level; lines are the hashes of those that are not empty, in order."""
    message = Window.partitionBy("conv", "turn", "message").orderBy("place")
    lines = quoted_lines(rows.select("conv", "turn", "text", F.monotonically_increasing_id().alias("message")))
    begins = F.when(F.col("level") == F.lag("level").over(message), 0).otherwise(1)
    lines = lines.withColumn("begins", begins).withColumn("run", F.sum("begins").over(message)).where("key <> ''")
    line = F.struct("place", *_hashes("key"))
    return lines.groupBy("conv", "turn", "message", "run", "level").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: F.struct(x.h1.alias("h1"), x.h2.alias("h2"))).alias("lines")).drop("message", "run")


def _latest(own: DataFrame, quotes: DataFrame) -> DataFrame:
    """The quotations with ``found``: the latest earlier turn that has (conv, h1, h2) among its own."""
    own = own.join(quotes.select("conv", "h1", "h2").distinct(), ["conv", "h1", "h2"], "left_semi").distinct().withColumn("original", F.col("turn"))
    same = Window.partitionBy("conv", "h1", "h2").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return own.unionByName(quotes, allowMissingColumns=True).withColumn("found", F.max("original").over(same)).where("level IS NOT NULL").drop("original")


def link_quotations(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, reply_to, n_quoted, n_linked), one row for each message: ``text`` is without quotations, ``reply_to`` is a turn, and the counts are of quoted lines."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("conv IS NOT NULL AND turn IS NOT NULL")
    has_quote = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?md)^[ \t]*>")

    passages = _runs(rows.where(has_quote)).where("level > 0").select("conv", "turn", "level", "lines", *_hashes("lines"))
    lengths = passages.groupBy("conv").agg(F.collect_set(F.size("lines")).alias("lengths"))
    own = _runs(rows.join(lengths.select("conv"), "conv", "left_semi")).where("level = 0").join(lengths, "conv")
    own = own.select("conv", "turn", "lines", F.explode("lengths").alias("n")).where("n <= size(lines)")
    pieces = F.transform(F.sequence(F.lit(1), F.size("lines") - F.col("n") + 1), lambda i: F.struct(*_hashes(F.slice("lines", i, F.col("n")))))
    own = own.select("conv", "turn", F.explode(pieces).alias("piece")).select("conv", "turn", "piece.h1", "piece.h2")
    passages = _latest(own, passages).select("conv", "turn", "level", "found", F.explode("lines").alias("line"))

    quotes = passages.select("conv", "turn", "level", F.col("found").alias("whole"), "line.h1", "line.h2")
    own = quoted_lines(rows.select("conv", "turn", "text")).where("level = 0 AND key <> ''").select("conv", "turn", *_hashes("key"))
    linked = _latest(own, quotes).withColumn("found", F.coalesce("whole", "found"))

    votes = linked.groupBy("conv", "turn", "found").agg(F.count(F.when(F.col("level") == 1, 1)).alias("votes"), F.count("*").alias("lines"))
    per_message = votes.groupBy("conv", "turn").agg(
        F.max_by("found", F.when(F.col("found").isNotNull() & (F.col("votes") > 0), F.struct("votes", "found"))).alias("quoted_turn"),
        F.sum("lines").alias("n_quoted"),
        F.coalesce(F.sum(F.when(F.col("found").isNotNull(), F.col("lines"))), F.lit(0)).alias("n_linked"),
    )
    turns = rows.select("conv", "turn").distinct().withColumn("previous", F.lag("turn").over(Window.partitionBy("conv").orderBy("turn")))
    replies = turns.join(per_message, ["conv", "turn"], "left").select("conv", "turn", F.coalesce("quoted_turn", "previous").alias("reply_to"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))

    kept = F.concat_ws("\n", F.filter(F.split("text", r"\r?\n"), lambda x: ~x.rlike(r"^[ \t]*>")))
    body = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?md)^[ \t]*>"), kept).otherwise(F.coalesce(F.col("text"), F.lit("")))
    out = rows.join(replies, ["conv", "turn"]).withColumn("body", body)
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("body").alias(text_col), "reply_to", "n_quoted", "n_linked")


def threads(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, thread): the first turn that each message's replies lead back to."""
    node = lambda turn: F.xxhash64(conv_col, turn)
    edges = messages.where("reply_to IS NOT NULL").select(node(turn_col).alias("a"), node("reply_to").alias("b"))
    found = connected_components(edges, "threads")
    named = messages.select(conv_col, turn_col).distinct().withColumn("node", node(turn_col)).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min(turn_col).alias("thread"))
    return named.join(first, "component").select(conv_col, turn_col, "thread")


def reply_order(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, reply_to, thread, place): place counts the turns of a thread from 0, every reply after what it replies to."""
    named = threads(messages, conv_col=conv_col, turn_col=turn_col)
    replies = messages.select(conv_col, turn_col, "reply_to").distinct()
    place = F.row_number().over(Window.partitionBy(conv_col, "thread").orderBy(turn_col)) - 1
    return replies.join(named, [conv_col, turn_col]).withColumn("place", place)
