"""Exact n-gram Jaccard join with signature trees.

1. Every text becomes a set of hashed word shingles (64 bits).  Equal sets are one class from here on.
2. Which shingles occur in one set only?  A third of the hash space (``universe``) is counted over the
   whole corpus: (hash, document) rows, dealt by range so that a very common shingle spreads over
   tasks, are streamed once.  Two sets of similarity t share one of the first ``n - ceil(t n) + 1``
   elements in any common order.  In the order rarest first, a document whose first elements are all
   unique has no partner; that ends the search for most documents.
3. The others deal out their remaining first elements.  Documents that share one are candidates; the
   candidates' connected components hold all links, as each link is a candidate pair.  Texts of a common vocabulary share
   elements by chance, the more the larger the corpus: the documents of components over ``narrow_over`` count all elements of their sets among
   themselves and choose first elements anew, again and again as long as that leaves fewer of them.
4. Components are only the routing: partitions hold many whole ones, and are joined with themselves by signature trees over
   the whole sets of all their documents.  Nodes hold the OR of their
   members' token bitmaps and their size range, pairs of nodes are traversed together and pruned when
   the greatest overlap that bitmaps and sizes allow is too small, or when all members of both are known
   to be connected.  What is left is compared exactly.  A component that is still of more than ``max_group`` documents (or ``max_bytes``)
   is cut into blocks which share some pivots; documents that then are not connected to the component's
   main part are compared, a block of them at a time, with every block of sizes that a link allows.  No pair is left out, and no
   tree has more than two blocks, whatever the component.

Links are exact on sets of 64-bit hashes.  Texts that are null, or have no word, have empty sets and no links;
texts with fewer words than a shingle are one shingle, the whole sequence.  A text's length has no bound, an empty
table gives an empty result, and only the id and text columns are looked at.

Every row is a document, in the order of the ids, of whatever type: rows that share an id (repeated rows, too)
are compared like others and have one line each in the result, rows without one come after all ids.  So a component's
smallest id is null only if no document in it has one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded, fresh, lower_ascii, materialize, mix, shuffle_partitions, signed, span_hashes, text_bytes, with_rows, word_bounds
from .components import connected_components

_HOT, _UNKNOWN = 63, 5  # classes are the binary logarithms of counts; shingles that were not counted rank as if in about 32 documents


def word_hashes(raw: bytes) -> np.ndarray:
    a = lower_ascii(np.frombuffer(raw, np.uint8))
    start, end = word_bounds(a)
    return span_hashes(a, start, end)


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = word_hashes(raw)
    if not len(h):
        return h
    width = min(k, len(h))
    factors = mix(np.arange(1, k + 1, dtype=U64) + U64(width << 8)) | U64(1)
    s = np.zeros(len(h) - width + 1, U64)
    for i in range(width):
        s += h[i : len(h) - width + 1 + i] * factors[i]
    return np.unique(mix(s))


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=U64)), int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))


def _counted(s: np.ndarray, universe: int) -> np.ndarray:
    return s % U64(universe) == 0


def _summaries(k: int, universe: int):
    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                s = shingle_set(text_bytes(value), k)
                rows.append((len(s), *_fingerprint(s), int(_counted(s, universe).sum())))
            n, f1, f2, u = (np.array(x, U64).view(np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, f1, f2, u))], names=["doc", "n", "f1", "f2", "u"])

    return run


def _elements(k: int, universe: int):
    """(h, doc) of the counted shingles, once for each set that a task meets."""

    def run(batches):
        met = set()
        for batch in batches:
            hs, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for doc, value in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), strict=True):
                s = shingle_set(text_bytes(value), k)
                f = _fingerprint(s)
                if f not in met:
                    met.add(f)
                    s = s[_counted(s, universe)]
                    hs.append(s)
                    docs.append(np.full(len(s), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hs))), pa.array(np.concatenate(docs))], names=["h", "doc"])

    return run


def _shared(batches):
    """From rows sorted by (h, doc): those of hashes in several rows, with the class of the count.

    The first and the last hash of a task may go on in another one, and runs too long to hold are cut;
    all rows of these get the highest class, so that a hash has one class everywhere.
    """

    def out(h, doc, cls):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(cls.astype(np.int32))], names=["doc", "h", "cls"])

    held, first, same = None, True, None
    for batch in batches:
        h, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(h):
            continue
        if same is not None:
            k = int(np.searchsorted(h, same, side="right"))
            if k:
                yield out(h[:k], doc[:k], np.full(k, _HOT))
            if k == len(h):
                continue
            h, doc, same = h[k:], doc[k:], None
        if held is not None:
            h, doc = np.concatenate((held[0], h)), np.concatenate((held[1], doc))
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            _, inverse, count = np.unique(h[:cut], return_inverse=True, return_counts=True)
            cls = np.log2(count).astype(int)[inverse]
            if first:
                cls[inverse == 0] = _HOT
            first = False
            several = cls > 0
            if several.any():
                yield out(h[:cut][several], doc[:cut][several], cls[several])
        held = (h[cut:], doc[cut:])
        if len(held[0]) > 200_000:
            yield out(*held, np.full(len(held[0]), _HOT))
            same, held, first = held[0][0], None, False
    if held is not None:
        yield out(*held, np.full(len(held[0]), _HOT))


def _prefix(s: np.ndarray, hs, cs, universe: int, num: int, den: int) -> np.ndarray:
    """The first elements of a set in the common order without those in one set only; ``hs`` are the others of the counted ones, with their classes."""
    cls = np.where(_counted(s, universe), 0, _UNKNOWN)
    h = np.array(hs.as_py() or [], np.int64).view(U64)
    cls[np.searchsorted(s, h)] = np.array(cs.as_py() or [], np.int64)
    order = np.lexsort((s, cls))[: prefix_length(len(s), num, den)]
    return signed(s[order][cls[order] > 0])


def _prefixes(k: int, universe: int, num: int, den: int):
    """(doc, n, set, prefix)"""

    def run(batches):
        for batch in batches:
            docs, ns, sets, prefixes = [], [], [], []
            for doc, value, hs, cs in zip(*batch.columns, strict=True):
                s = shingle_set(text_bytes(value), k)
                docs.append(doc.as_py())
                ns.append(len(s))
                sets.append(s.tobytes())
                prefixes.append(_prefix(s, hs, cs, universe, num, den))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ns, pa.int64()), pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc", "n", "elements", "prefix"])

    return run


def _set_elements(batches):
    """(h, doc) of all elements of sets (doc, elements)."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), U64) for x in batch.column(1)]
        docs = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([np.zeros(0, U64), *sets]))), pa.array(docs)], names=["h", "doc"])


def _set_prefixes(num: int, den: int):
    """(doc, prefix) of sets (doc, elements, hs, cs) of which all elements were counted."""

    def run(batches):
        for batch in batches:
            prefixes = [_prefix(np.frombuffer(x.as_buffer(), U64), hs, cs, 1, num, den) for x, hs, cs in zip(*batch.columns[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc", "prefix"])

    return run


def _shared_elements(elements: DataFrame, tag: str) -> DataFrame:
    """(doc, h, cls) of the elements (h, doc) that several documents have."""
    dealt = elements.repartitionByRange(shuffle_partitions(elements.sparkSession), "h", "doc").sortWithinPartitions("h", "doc")
    return materialize(dealt.mapInArrow(_shared, "doc long, h long, cls int"), tag)


def _components(prefixes: DataFrame, tag: str) -> DataFrame:
    """(node, component, size): the documents (doc, prefix) that share a first element with another one."""
    postings = prefixes.select("doc", F.explode("prefix").alias("h"))
    leaders = postings.groupBy("h").agg(F.min("doc").alias("b"), F.count("*").alias("c")).where("c > 1").select("h", "b")
    edges = postings.join(leaders, "h").where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()
    found = connected_components(edges, tag)
    return materialize(found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size"), tag)


def _narrow(sets: DataFrame, candidates: DataFrame, num: int, den: int, narrow_over: int) -> DataFrame:
    """The candidates (node, component, size) without those that only share elements by chance with others of their large components.

    Partners are in one component.  So a set has a partner only if ``num / den`` of its elements are in other sets of large components, too.
    """
    before = None
    while True:
        large = candidates.where(F.col("size") > narrow_over)
        n = large.count()
        if not n or before is not None and n > 0.9 * before:
            return candidates
        before = n
        some = materialize(sets.join(large.select(F.col("node").alias("doc")), "doc").select("doc", "elements"), "large-sets")
        shared = _shared_elements(some.mapInArrow(_set_elements, "h long, doc long"), "large-shared")
        lists = shared.groupBy("doc").agg(F.collect_list("h").alias("hs"), F.collect_list("cls").alias("cs"))
        prefixes = some.join(lists, "doc").select("doc", "elements", "hs", "cs").mapInArrow(_set_prefixes(num, den), "doc long, prefix array<long>")
        again = _components(materialize(prefixes, "large-prefixes"), "narrowed")
        candidates = candidates.where(F.col("size") <= narrow_over).unionByName(again)


# ---------------------------------------------------------------- the signature tree


class SignatureTree:
    """A tree over sets, sorted by size and smallest hash: nodes have OR-combined bitmaps, size ranges and the most elements that share a bit in a member."""

    def __init__(self, sets: list[np.ndarray], leaf: int = 4, fan: int = 4):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][: min(2, len(sets[i]))].tolist()))
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        width = 256
        while width < 4 * self.sizes.max() and width < 1 << 16:
            width *= 2
        packed = np.zeros((len(sets), width // 8), np.uint8)
        for row, s in zip(packed, self.sets, strict=True):
            bits = np.zeros(width, bool)
            bits[(s % U64(width)).astype(np.int64)] = True
            row[:] = np.packbits(bits)
        self.bits = packed.view(U64)
        double = self.sizes - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        bounds = list(range(0, len(sets), leaf)) + [len(sets)]
        self.levels = []
        low, high, most, bits = self.sizes, self.sizes, double, self.bits
        starts = np.array(bounds[:-1])
        while True:
            low, high, most = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(most, starts)
            bits = np.bitwise_or.reduceat(bits, starts, axis=0)
            self.levels.append((bounds, low, high, most, bits))
            if len(starts) == 1:
                break
            starts = np.arange(0, len(low), fan)
            bounds = [*(bounds[i] for i in starts), len(sets)]
        self.double, self.fan = double, fan


def _overlap(bits_a, bits_b, most_a, most_b, high_a, high_b):
    """The greatest overlap that two members of nodes can have."""
    common = np.bitwise_count(bits_a & bits_b).sum(-1).astype(np.int64) + np.minimum(most_a, most_b)
    return np.minimum(common, np.minimum(high_a, high_b))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


_CHUNK = 2048  # pairs whose bitmaps are compared at once


def linked_labels(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None) -> np.ndarray:
    """A label for each set, equal for sets connected by links; ``labels`` are those known before.

    The tree is traversed against itself, all pairs of nodes of a level at once.  Pairs within what is connected already are skipped.
    """
    tree = SignatureTree(sets)
    label = np.arange(len(sets)) if labels is None else labels[tree.order].copy()
    sizes, levels, fan = tree.sizes, tree.levels, tree.fan

    def possible(a, b, low, high, most, bits) -> np.ndarray:
        """Which pairs of nodes may have members with a link."""
        ok = den * np.minimum(high[a], high[b]) >= num * np.maximum(low[a], low[b])
        live = np.flatnonzero(ok & (a != b))
        for k in range(0, len(live), _CHUNK):
            at = live[k : k + _CHUNK]
            x, y = a[at], b[at]
            bound = _overlap(bits[x], bits[y], most[x], most[y], high[x], high[y])
            ok[at] = den * bound >= num * (low[x] + low[y] - bound)
        return ok

    def compare(a, b) -> None:
        ok = label[a] != label[b]
        a, b = a[ok], b[ok]
        ok = possible(a, b, sizes, sizes, tree.double, tree.bits)
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if label[j] != label[i]:
                both = intersection(tree.sets[i], tree.sets[j])
                if den * both >= num * (len(tree.sets[i]) + len(tree.sets[j]) - both):
                    label[label == label[j]] = label[i]

    at = np.arange(1, len(sets))
    compare(at - 1, at)  # neighbours in the order of the tree
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        bounds, low, high, most, bits = levels[depth]
        starts = np.array(bounds[:-1])
        one, other = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        ok = ~((one[a] == other[a]) & (one[b] == other[b]) & (one[a] == one[b]))
        a, b = a[ok], b[ok]
        ok = possible(a, b, low, high, most, bits)
        a, b = a[ok], b[ok]
        # Parts of both nodes: nodes of the level below, or members.
        first, last = (starts, np.array(bounds[1:])) if not depth else (np.arange(len(low)) * fan, np.minimum((np.arange(len(low)) + 1) * fan, len(levels[depth - 1][1])))
        wide = int((last - first).max())
        x, y = (g.ravel() for g in np.meshgrid(np.arange(wide), np.arange(wide), indexing="ij"))

        def parts(a, b):
            left, right = first[a][:, None] + x, first[b][:, None] + y
            ok = (left < last[a][:, None]) & (right < last[b][:, None]) & ((left < right) if not depth else (left <= right))
            return left[ok], right[ok]

        if depth:
            a, b = parts(a, b)
        else:  # most pairs are here
            for k in range(0, len(a), _CHUNK):
                compare(*parts(a[k : k + _CHUNK], b[k : k + _CHUNK]))
    out = np.empty_like(label)
    out[tree.order] = label
    return out


def _verify(num: int, den: int, most_rows: int = 512, most_bytes: int = 16 << 20):
    """Labels of the rows (key, part, doc, label, elements) of a partition, sorted by key and part; the label is the smallest document that one of the same connected documents had.

    A tree holds whole groups, as many as come together to ``most_rows`` documents or ``most_bytes``, and is joined with itself.
    """

    def solve(rows):
        docs = np.array([r[0] for r in rows])
        order = np.unique(docs, return_index=True)[1]
        rows = [rows[i] for i in order]
        docs, before = docs[order], np.array([r[1] for r in rows])
        label = linked_labels([np.frombuffer(r[2], U64) for r in rows], num, den, before) if len(rows) > 1 else before
        _, inverse = np.unique(label, return_inverse=True)
        least = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, before)
        a = np.concatenate((docs, before))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate((least[inverse], least[inverse])))], names=["a", "b"])

    def run(batches):
        key, rows, size = None, [], 0
        for batch in batches:
            for k, part, doc, label, elements in zip(*batch.columns, strict=True):
                at = (k.as_py(), part.as_py())
                if at != key:
                    if len(rows) >= most_rows or size >= most_bytes:
                        yield solve(rows)
                        rows, size = [], 0
                    key = at
                rows.append((doc.as_py(), label.as_py(), elements.as_py()))
                size += len(rows[-1][2])
        if rows:
            yield solve(rows)

    return run


def _solve(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) edges from documents and earlier labels to their labels."""
    dealt = groups.select("key", "part", "doc", "label", "elements").repartition(shuffle_partitions(groups.sparkSession), "key", "part")
    return dealt.sortWithinPartitions("key", "part", "doc").mapInArrow(_verify(num, den), "a long, b long")


def _blocks(size, n, max_group: int, max_bytes: int):
    """How many blocks ``size`` sets of together ``n`` elements make."""
    return F.ceil(F.greatest(size / max_group, 8 * n / max_bytes)).cast("int")


def _search(sets: DataFrame, candidates: DataFrame, num: int, den: int, max_group: int, max_bytes: int, pivots: int) -> DataFrame:
    """(node, component) of the linked documents among the candidates (node, component)."""
    member = candidates.select(F.col("node").alias("doc"), F.col("component").alias("key"))
    sizes = sets.select("doc", "n").join(member, "doc").groupBy("key").agg(F.count("*").alias("size"), _blocks(F.count("*"), F.sum("n"), max_group, max_bytes).alias("blocks"))
    grouped = sets.select("doc", "n", "elements").join(member.join(sizes, "key"), "doc")
    part = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    grouped = materialize(grouped.select("key", "doc", "n", "elements", "size", "blocks", part.alias("part"), F.col("doc").alias("label")), "groups")
    large = grouped.where("blocks > 1")
    if large.isEmpty():
        return connected_components(materialize(_solve(grouped, num, den), "first"), "links")
    # Some documents of each large component, chosen by hash, join all its blocks.
    row = ["key", "part", "doc", "label", "elements"]
    chance = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("size")) < pivots
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")
    shared = large.where(chance).select("key", everywhere, "doc", "label", "elements")
    first = materialize(_solve(grouped.select(*row).unionByName(shared), num, den), "first")
    known = connected_components(first, "blocks").select(F.col("node").alias("doc"), F.col("component").alias("known"))
    # Sizes that a link allows are in the same band or in neighbouring ones.
    band = F.floor(F.log("n") / (1.0001 * max(math.log(den / num), 0.01))).cast("int").alias("band")
    large = large.join(known, "doc", "left").select("key", "doc", "n", "elements", band, F.coalesce("known", "doc").alias("label"))
    counts = large.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    large = materialize(large.join(main, "key"), "large")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    rest = large.where("label <> main").select("key", "doc", "n", "elements", near, "label")
    count = lambda df, name: df.groupBy("key", "band").agg(_blocks(F.count("*"), F.sum("n"), max_group, max_bytes).alias(name))
    strata = count(large, "many").join(count(rest, "few"), ["key", "band"])
    each = lambda name, number: F.explode(F.sequence(F.lit(0), F.col(number) - 1)).alias(name)
    own = lambda name, number: F.pmod(F.xxhash64("doc", F.lit(2)), F.col(number)).cast("int").alias(name)
    pair = F.shiftleft(F.col("band").cast("long"), 40) + F.shiftleft(F.col("i").cast("long"), 20) + F.col("j")
    sides = [df.join(strata, ["key", "band"]).select("key", "band", "doc", "label", "elements", i, j) for df, i, j in ((large, own("i", "many"), each("j", "few")), (rest, each("i", "many"), own("j", "few")))]
    again = sides[0].unionByName(sides[1]).withColumn("part", pair).select(*row)
    return connected_components(first.unionByName(materialize(_solve(again, num, den), "second")), "links")


def similar_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_shingles, component_id): the set size of each document and the smallest id that links of Jaccard >= num/den lead to, its own included."""
    bounded(df)
    df = df.select(id_col, text_col)
    row = fresh(df, "row")
    rows, plain = with_rows(df, row, id_col=id_col, text_col=text_col)
    found = row_components(rows.select(F.col(row).alias("doc"), F.col(text_col).alias("text")), **options)
    if plain:
        kind = df.schema[id_col].dataType
        return found.select(F.col("doc").cast(kind).alias(id_col), "n_shingles", F.col("component").cast(kind).alias("component_id"))
    names = rows.select(F.col(row).alias("__row"), F.col(id_col).alias("__id"))
    own = found.join(names, F.col("doc") == F.col("__row")).select(F.col("__id").alias(id_col), "n_shingles", "component")
    return own.join(names.withColumnRenamed("__id", "component_id"), F.col("component") == F.col("__row")).select(id_col, "n_shingles", "component_id")


def row_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, universe: int = 3, max_group: int = 1024, max_bytes: int = 16 << 20, pivots: int = 16, narrow_over: int = 4096) -> DataFrame:
    """(doc, n_shingles, component) of rows (doc, text), where ``doc`` is a long that differs in all rows."""
    named = docs
    summary = materialize(docs.mapInArrow(_summaries(k, universe), "doc long, n long, f1 long, f2 long, u long"), "summary")
    elements = named.mapInArrow(_elements(k, universe), "h long, doc long")
    shared = _shared_elements(elements, "shared")

    # Documents with too few unique elements for a whole prefix, one of each class of equal sets.
    counts = shared.groupBy("doc").agg(F.count("*").alias("c"))
    some = summary.where("n > 0").join(counts, "doc", "left").where(F.col("u") - F.coalesce("c", F.lit(0)) < F.expr(f"n - ceil({num} * n / {den}) + 1"))
    # A task emits a set once; of the others of its class only those that were emitted have counts, unless no element of the set is counted at all.
    ranked = some.groupBy("f1", "f2").agg(F.min_by("doc", F.struct(F.col("c").isNull(), "doc")).alias("doc"))
    lists = shared.groupBy("doc").agg(F.collect_list("h").alias("hs"), F.collect_list("cls").alias("cs"))
    chosen = named.join(ranked.select("doc"), "doc").join(lists, "doc", "left").select("doc", "text", "hs", "cs")
    sets = materialize(chosen.mapInArrow(_prefixes(k, universe, num, den), "doc long, n long, elements binary, prefix array<long>"), "sets")

    candidates = _narrow(sets, _components(sets, "candidates"), num, den, narrow_over)
    links = _search(sets, candidates, num, den, max_group, max_bytes, pivots)

    classes = summary.where("n > 0").groupBy("f1", "f2").agg(F.min("doc").alias("least"))
    label = summary.join(links, F.col("doc") == F.col("node")).select("f1", "f2", "component")
    named_classes = classes.join(label, ["f1", "f2"], "left")
    least = named_classes.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("linked"))
    classes = named_classes.join(least, "component", "left").select("f1", "f2", F.coalesce("linked", "least").alias("component_id"))
    out = summary.join(classes, ["f1", "f2"], "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id")).alias("component"))


def keep_one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that come first in their components, in the order of the ids; rows without an id come last."""
    bounded(df)
    row = fresh(df, "row")
    rows, _ = with_rows(df, row, id_col=id_col, text_col=text_col)
    found = row_components(rows.select(F.col(row).alias("doc"), F.col(text_col).alias("text")), **options)
    return rows.join(found.where("doc = component").select(F.col("doc").alias(row)), row, "left_semi").select(*df.columns)
