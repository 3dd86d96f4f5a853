"""The operators over their whole test tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, decontamination, jaccard_join, line_dedup, line_rules, packing, prefix_trie, quality, quotes, repeats, spelling, token_counts, vector_graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), max_labelled=3000)
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(_table(spark, sf_dir, "conversations"))


def op5_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(quotes.link_quotations(_table(spark, sf_dir, "conversations")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archives.round_trip(_table(spark, sf_dir, "pages"), min_revisit=100)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = line_rules.train(docs, _table(spark, sf_dir, "labels"), max_labelled=1500)
    return line_rules.apply_rules(docs, field)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    joined = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), "contaminated")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"))


def op11_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_copies(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), drop_every=97, min_chars=5, min_count=3)
    return spelling.group_variants(words, ratio=2)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.encode_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.graft_heads(turns, every=20, heads=4))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_quality, op4_jaccard_join, op5_quotes, op5_reply_order, op6_warc, op7_line_rules, op8_packing, op9_decontamination, op10_suffix_dedup, op11_vector_graph, op12_spelling, op13_prefix_trie)}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_warc": r"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)""",
    "op9_decontamination": r"""
WITH doc_words AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)),
places AS (
  SELECT row, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words CROSS JOIN (SELECT DISTINCT n FROM windows))),
hits AS (SELECT row, item, i, p.n FROM places p JOIN windows USING (n, words)),
hit_words AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS place FROM hits) GROUP BY row),
hit_items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)""",
    "op11_vector_graph": r"""
WITH RECURSIVE valid AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = r.vec_id) AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM reached r GROUP BY vec_id""",
    "op12_spelling": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS steps FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))),
           lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table),
vocabulary AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocabulary)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT c.word, v.word FROM cuts c JOIN vocabulary v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM cuts c JOIN vocabulary v ON v.word = c.rest),
ranked AS (
  SELECT near.word, other, n, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place, count(*) OVER (PARTITION BY near.word) AS n_near
  FROM near JOIN vocabulary v ON v.word = other),
forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN other END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
  FROM vocabulary v LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r ON r.word = v.word),
ways AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ways w USING (word) JOIN forms l ON l.word = w.at WHERE l.form IS NULL""",
    "op13_prefix_trie": r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS steps FROM (SELECT unnest(range(256)) AS i)),
ordered AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM ordered, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1 : c.h], []), c.turns[c.h + 1 :]) AS turns
  FROM hashed c LEFT JOIN ordered b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (
  SELECT conv_id, len(turns) AS n, d, turns[1 : d] AS prefix, CASE WHEN d = 0 THEN '' ELSE turns[d].text END AS last
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
members AS (SELECT conv_id, n, d, last, min(conv_id) OVER (PARTITION BY d, prefix) AS node FROM prefixes),
nodes AS (
  SELECT node, d, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(last), '[^\x20\x09-\x0D]+')) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM members GROUP BY node, d),
linked AS (SELECT x.*, m.node AS parent FROM nodes x LEFT JOIN members m ON m.conv_id = x.node AND m.d = x.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS k FROM linked WHERE d > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(k, 0) AS k FROM linked l LEFT JOIN children USING (node, d)),
subtrees AS (
  SELECT m.node, m.d, count(*) FILTER (WHERE x.k = 0) AS leaves, sum(x.saved) AS saved
  FROM counted x JOIN members m ON m.conv_id = x.node AND m.d <= x.d GROUP BY ALL)
SELECT c.node AS conv_id, CAST(c.d AS BIGINT) AS depth, c.parent AS parent_conv_id, c.n_convs, c.k AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s USING (node, d)""",
}
