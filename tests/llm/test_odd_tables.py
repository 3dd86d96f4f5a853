"""Texts made to collide, very long texts, ids of other types, repeated and absent ids, empty tables, names that clash."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from netlytics.llm import decontamination, jaccard_join, line_dedup, line_rules, packing, quality, queries, quotes, repeats, token_counts
from test_dedup import brute_components, brute_lines, brute_repeats
from test_web_and_chat import brute_contamination

CLASHES = ("row", "score", "predicted", "n_lines", "n_dropped", "__doc", "bitmap", "lines", "dropped", "component_id", "doc", "h", "fps", "words", "n_bytes", "kept")


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.fixture(scope="module")
def colliding():
    """Strings and their complements: equal under every sum of powers modulo 2**64."""
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    return [x, x, y, x + " tail", y + " tail", x[:1024], y[:1024], x[:1024], "head of it " + y, "another head " + y, None, ""]


def frame(spark, texts, ids=None, parts=4):
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {'string' if any(isinstance(i, str) for i in ids) else 'long'}, text string")
    return df.withColumns({c: F.lit(7) for c in CLASHES if c not in ("words",)}).withColumn("words", F.lit("x")).repartition(parts)


def test_lines_that_collide(spark, colliding):
    for case in (colliding, colliding[:3]):
        out = line_dedup.dedup_lines(frame(spark, case), min_docs=2).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out} == brute_lines(case, 20, 2)


def test_words_that_collide(spark, colliding):
    out = jaccard_join.similar_components(frame(spark, colliding), k=4, num=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(colliding, 4, 85, 100)
    again = " ".join(thue_morse(64)) + " " + " ".join(f"{thue_morse(1024)} {thue_morse(1024, 'b', 'a')}" for _ in range(3))
    words = again.split()
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    want = len({j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})
    assert line_rules.base_counts(again.encode())["n_repeat_words"] == want


@pytest.mark.parametrize("hot", [4096, 1])
def test_windows_that_collide(spark, colliding, hot):
    out = repeats.remove_repeats(frame(spark, colliding), length=400, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == brute_repeats(colliding, 400)


WORDS = " ".join(f"w{i}" for i in range(40))
ROWS = [("b", WORDS), ("b", WORDS), ("a", "own words of this one only, and no other"), (None, WORDS + " end"), (None, None), ("c", "x" * 30 + "\n" + WORDS), ("d", "x" * 30 + "\nq"), ("a", "x" * 30), ("", "")]


def ranked(first: bool):
    """The texts in the order of (id, text), nulls first or last, with the ids: rows as the operators count them."""
    key = lambda r: ((r[0] is None) != first, r[0] or "", r[1] is not None, r[1] or "")
    return sorted(ROWS, key=key)


def test_string_and_repeated_ids(spark):
    df = frame(spark, [t for _, t in ROWS], [i for i, _ in ROWS])
    same = lambda got, want: sorted(got, key=str) == sorted(want, key=str)
    rows = ranked(True)
    lines = brute_lines([t for _, t in rows], 20, 3)
    assert same([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()], [(rows[k][0], *lines[k]) for k in lines])
    rows = ranked(False)
    near = brute_components([t for _, t in rows], 4, 85, 100)
    assert same([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df, k=4, num=85).collect()], [(rows[k][0], n, rows[c][0]) for k, (n, c) in near.items()])
    cut = brute_repeats([t for _, t in rows], 50)
    got = repeats.remove_repeats(df, length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert same(map(tuple, got), [(rows[k][0], *v) for k, v in cut.items()])
    items = [("i1", " ".join(f"w{i}" for i in range(5, 25))), ("i0", " ".join(f"w{i}" for i in range(10, 23))), (None, WORDS)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    dirty = brute_contamination([(k, t) for k, (_, t) in enumerate(rows)], items[:2], 13)
    got = decontamination.contamination(df, benchmark).collect()
    assert same([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], [(rows[k][0], *v) for k, v in dirty.items()])
    assert same([(r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, queries.tokenizer_path()).collect()], [(i, token_counts.load(queries.tokenizer_path()).count(t or "")) for i, t in ROWS])
    assert packing.pack_documents(df, queries.tokenizer_path()).groupBy("doc_id").count().count() == 6
    assert quality.score(df, quality.train(df, spark.createDataFrame([("b", 1)], "doc_id string, quality int"))).count() == len(ROWS)
    assert line_rules.apply_rules(df, line_rules.all_content()).count() == len(ROWS)


def test_long_texts(spark):
    """Rows over an Arrow batch, in one word, in one line, and in many."""
    prose = " ".join(f"w{i}" for i in range(800_000))
    texts = [prose, prose, "y" * 6_000_000, "\n".join(f"line number {i} of a very long text" for i in range(150_000)), prose + " more", "short"]
    df = frame(spark, texts, parts=3)
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df, min_docs=2).collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_components(df, k=4, num=85).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5}
    gone = {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert gone == {0: len(prose), 1: len(prose), 2: 6_000_000, 3: 0, 4: len(prose), 5: 0}
    item = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500, 520)))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.contamination(df, item).collect()} == {0: 20, 1: 20, 2: 0, 3: 0, 4: 20, 5: 0}
    counts = {r.doc_id: r.n_words for r in line_rules.apply_rules(df, line_rules.all_content()).collect()}
    assert counts == {k: len(t.split()) for k, t in enumerate(texts)}
    assert all(0 <= r.score <= 1 for r in quality.score(df, quality.AttentionModel()).select("score").collect())


def test_one_word_again_and_again(spark):
    """Places of documents and items are not multiplied."""
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "b")], "doc_id long, text string")
    item = spark.createDataFrame([(i, "a " * 400) for i in range(5)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, len(r["items"]), r.contaminated) for r in decontamination.contamination(docs, item).collect()}
    assert got == {1: (20_000, 5, True), 2: (0, 0, False)}


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_queries_over_empty_tables(spark, tmp_path):
    folder = tables(spark, str(tmp_path), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), [], [])
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() == 0, name
    assert C.run(spark, folder).count() == 0


def test_pipeline_with_odd_tables(spark, tmp_path):
    """Columns that clash, no ``n_chars``, ids that repeat or are absent, no labels, no benchmark."""
    rows = [(i, t) for i, t in enumerate([WORDS, WORDS, None, "", "own text of this document"])] + [(1, "another"), (None, WORDS), (None, "without an id")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    folder = tables(spark, str(tmp_path), docs, [], [])
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        kept = C.materialize(stage(spark, kept, folder), "odd")
        assert kept.columns == docs.columns, name
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(0, ""), (1, WORDS), (2, ""), (3, ""), (4, rows[4][1]), (1, "another"), (None, ""), (None, "without an id")], key=str)
    assert all(r.score == 7 and r.n_lines == 7 for r in kept.select("score", "n_lines").collect())
    assert C.run(spark, folder).select("doc_id").distinct().count() == 6


def test_nothing_quoted_and_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert quotes.reply_order(quotes.link_quotations(none)).count() == 0
