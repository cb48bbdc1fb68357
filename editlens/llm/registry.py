"""The corpus operators as named queries over the driver tables, each with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, format_chats

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    return digests(format_chats(turns.unionByName(tricky)))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import quantized, top_k

    rows = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives
    from .vector_search import quantized

    rows = quantized(table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label").where("label IS NOT NULL"), 256, "label")
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"pipeline": pipeline}


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sets s ON s.doc_id = p.a JOIN sets t ON t.doc_id = p.b
  WHERE 100 * p.both >= 80 * (len(s.s) + len(t.s) - p.both)),
reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION
  SELECT r.id, CASE WHEN l.a = r.seen THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.seen OR l.b = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(1024 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM c q JOIN c d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
s AS (SELECT q.vec_id AS anchor_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score FROM c q JOIN c d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
l AS (SELECT s.*, a.label = b.label AS same FROM s JOIN v a ON a.vec_id = anchor_id JOIN v b ON b.vec_id = s.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM l WHERE same) x WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, l.vec_id AS negative_id, p.score AS positive_score, l.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY l.score DESC, l.vec_id) AS INTEGER) AS rank
  FROM p JOIN l ON l.anchor_id = p.anchor_id AND NOT l.same AND 80 * p.score <= 100 * l.score AND l.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
tokens AS (SELECT id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS (SELECT d.lang, d.source, coalesce(v.v, 0) AS v, coalesce(s.n, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN vocabulary v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY 1, 2) s USING (lang, source)),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
langs AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (any_value(t.total) + any_value(t.v)) AS q
  FROM counts JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM groups GROUP BY 1) t USING (lang) GROUP BY 1, 2),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
terms AS (SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value FROM shares s JOIN langs l ON s.lang = l.lang AND s.term = l.term WHERE s.n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql():
    return {"op1_exact_top_k": OP1_SQL, "op6_minhash_near_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_source_divergence": OP13_SQL}
