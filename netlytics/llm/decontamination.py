"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are maximal runs without ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased.  An
item's windows are its runs of ``window`` words (a shorter item is one window).  A document keeps the
smallest hash of its k-word grams in every run of ``span`` words, for each length ``span`` of windows that
items have: one, or a few more where items are short.  An item keeps those for its own length.
Equal runs keep equal hashes, so every window that occurs in a document shares one.

1. Documents' kept hashes join the items' kept hashes.  Only numbers are joined; Spark broadcasts the
   items' side while it is under its threshold and sorts and splits otherwise.
2. A window that occurs in an item has its smallest hash among these.  So only the documents with a match, and in
   them only the windows whose smallest hash matched, are compared with the items' windows, word by word: hits do not depend
   on hashes.  A place of a document meets a window once, however often items repeat it, and overlapping hits are
   merged into runs; repetitive texts cost no more than others.

Every row is a document and judged by itself: ids may be of any type, absent or shared (repeated rows get equal verdicts).
Null texts have no words, and texts of any length are read whole.  Items without an id are left out; items may share texts.  An empty benchmark hits nothing, an
empty table gives an empty result.  Only the id and text columns are looked at, so no other name clashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, with_rows

#: Tables up to this many rows are broadcast after they were counted; larger ones are joined by shuffles.
BROADCAST_ROWS = 100_000
_SALTS = 16
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _over_runs(array: Column, n: int, join) -> Column:
    """``join`` folded over each run of n neighbours: pairs, pairs of pairs and so on, the last two overlapping."""

    def step(array: Column, by: int) -> Column:
        def pairs(a: Column) -> Column:
            left = F.greatest(F.size(a) - by, F.lit(0))
            return F.zip_with(F.slice(a, F.lit(1), left), F.slice(a, F.lit(by + 1), left), join)

        return _let(array, pairs)

    reach = 1
    while reach * 2 <= n:
        array, reach = step(array, reach), reach * 2
    return step(array, n - reach) if reach < n else array


def grams(array: Column, k: int) -> Column:
    """64-bit hashes of the k-word grams."""
    return _over_runs(F.transform(array, lambda w: F.xxhash64(w)), k, lambda a, b: F.xxhash64(a, b))


def kept_hashes(gram: Column, w: int) -> Column:
    """The smallest hash in each run of w grams."""
    return _over_runs(gram, w, lambda a, b: F.least(a, b))


def _meet(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """The join of a large table with one of ``rows`` rows whose keys are few and may be very common in the large one."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on)
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    return left.withColumn("salt", F.pmod(F.col("doc"), F.lit(_SALTS)).cast("int")).join(right.select("*", salts), [*on, "salt"]).drop("salt")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) of each document: the words in windows of items, the ids of these items, and whether they are a ``share`` of the words."""
    docs = docs.select(id_col, text_col)
    row = fresh(docs, "row")
    rows, plain = with_rows(docs, row, id_col=id_col, text_col=text_col)
    found = row_contamination(rows.select(F.col(row).alias("doc"), F.col(text_col).alias("text")), benchmark, **options)
    if plain:
        return found.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_hit", "items", "contaminated")
    names = rows.select(F.col(row).alias("doc"), F.col(id_col).alias("__id"))
    return found.join(names, "doc").select(F.col("__id").alias(id_col), "n_words", "n_hit", "items", "contaminated")


def row_contamination(
    source: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = 13, gram: int = 6, share: tuple[int, int] = (1, 20)
) -> DataFrame:
    """(doc, n_words, n_hit, items, contaminated) of rows (doc, text), where ``doc`` is a long that differs in all rows."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("item_words")).where("item IS NOT NULL AND size(item_words) > 0")
    length = F.least(F.lit(window), F.size("item_words"))
    spans = sorted(r[0] for r in items.select(length).distinct().collect()) or [window]  # at most ``window`` numbers

    def item_hashes(span: int) -> DataFrame:
        k = min(gram, span)
        return items.where(length == span).select(F.explode(kept_hashes(grams(F.col("item_words"), k), span - k + 1)).alias("fp"))

    found = reduce(DataFrame.unionByName, map(item_hashes, spans)).distinct()

    counted = source.select("doc", words(F.col("text")).alias("words"))
    # One more row for each document, without a hash, carries its word count to the same grouping.
    def kept(x: Column) -> Column:
        return F.concat(*[kept_hashes(grams(x, min(gram, s)), s - min(gram, s) + 1) for s in spans])

    both = _let(F.col("words"), lambda x: F.struct(F.size(x).alias("n_words"), F.array_append(F.array_distinct(kept(x)), F.lit(None).cast("long")).alias("fps")))
    hashed = counted.select("doc", both.alias("b")).select("doc", F.col("b.n_words").alias("n_words"), F.explode("b.fps").alias("fp"))
    met = hashed.join(found.withColumn("met", F.lit(True)), "fp", "left").where("met OR fp IS NULL")
    per_doc = materialize(met.groupBy("doc").agg(F.max("n_words").alias("n_words"), F.collect_set("fp").alias("fps")), "fingerprints")

    # The items' windows, each with the set of items that have it; windows share their sets, and sets have numbers.
    starts = F.sequence(F.lit(1), F.size("item_words") - length + 1)
    windows = items.select("item", length.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("item_words", i, length), " "))).alias("words"))
    windows = windows.groupBy("n", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = materialize(windows.withColumn("items_of", F.struct(F.xxhash64("items").alias("h1"), F.xxhash64(F.lit(1), "items").alias("h2"))), "windows")
    n_windows = windows.count()

    candidates = per_doc.where("size(fps) > 0").select("doc", "fps")
    size = candidates.agg(F.sum(F.size("fps") + 1)).first()[0] or 0
    texts = source.join(F.broadcast(candidates) if size <= BROADCAST_ROWS * 4 else candidates, "doc").select("doc", "fps", words(F.col("text")).alias("words"))

    def matching(span: int) -> Column:
        """The windows of ``span`` words whose smallest hash matched."""
        k = min(gram, span)
        marked = F.transform(kept_hashes(grams(F.col("words"), k), span - k + 1), lambda h, i: F.when(F.array_contains("fps", h), i))
        return F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.struct(F.lit(span).alias("n"), i.alias("at"), F.array_join(F.slice("words", i + 1, span), " ").alias("words")))

    places = texts.select("doc", F.explode(F.concat(*map(matching, spans))).alias("w")).select("doc", "w.n", "w.at", "w.words")
    matched = _meet(places, windows.select("n", "words", "items_of"), ["n", "words"], n_windows)
    per_hit = matched.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("places"), F.collect_set("items_of").alias("sets"))
    per_hit = materialize(per_hit, "hits")

    def merge(done: Column, place: Column) -> Column:
        end = place["at"] + place["n"]
        return F.struct(F.greatest(done["end"], end).alias("end"), (done["hit"] + F.greatest(F.lit(0), end - F.greatest(done["end"], place["at"]))).alias("hit"))

    n_hit = F.aggregate("places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), merge, lambda done: done["hit"])
    sets = windows.select("items_of", "items").dropDuplicates(["items_of"])
    named = _meet(per_hit.select("doc", F.explode("sets").alias("items_of")), sets, ["items_of"], n_windows).select("doc", F.explode("items").alias("item"))
    hits = per_hit.select("doc", n_hit.alias("n_hit")).join(named.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items")), "doc")

    out = per_doc.select("doc", "n_words").join(hits, "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share[1] >= F.col("n_words") * share[0])).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated documents; every row is one, with an id of its own or not."""
    row = fresh(docs, "row")
    rows, _ = with_rows(docs, row, id_col=id_col, text_col=text_col)
    found = row_contamination(rows.select(F.col(row).alias("doc"), F.col(text_col).alias("text")), benchmark, **options)
    return rows.join(found.where("contaminated").select(F.col("doc").alias(row)), row, "left_anti").select(*docs.columns)
