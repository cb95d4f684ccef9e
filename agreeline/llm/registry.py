"""Queries of the training-data operators, each over its whole table, with SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, bpe, decontaminate, jaccard, language, mixing, pii, quality_rules, spelling, tokens, topk, toxicity, weak_quality
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counted = tokens.with_token_counts(docs, vocabulary_path("byte_bpe_50k.tiktoken"), ["source"])
    return tokens.length_histogram(counted, "source")


@_query
def op4_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


@_query
def op6_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(read(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int"), F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards")
    )


@_query
def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(read(spark, sf_dir, "documents"), pii.session_key(spark), found="found")
    of_kind = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).alias(f"n_{k}")
    counts = [of_kind(k) for k in pii.KINDS]
    return out.select("doc_id", "text", *counts, F.transform("found", lambda s: s["pseudonym"]).alias("pseudonyms"))


@_query
def op8_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = toxicity.score(docs, labels, fold("doc_id", 4) != 2)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op3_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language.identify(docs, docs.filter(fold("doc_id", 5) != 0))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@_query
def op10_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op10_segment_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op2_host_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, g)) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), b AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    CASE WHEN len(w) = 0 THEN 0 ELSE length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) END::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words
      OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS any_failed FROM b
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(any_failed::INT)::DOUBLE AS k FROM f GROUP BY source
), m AS (
  SELECT sum(n) AS total, sum(k) / sum(n) AS m, greatest(sum(n * (k / n) * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)), 0) AS v FROM h
), s AS (
  SELECT *, CASE WHEN v > 0 THEN least(total, greatest(1, m * (1 - m) / v - 1)) ELSE total END AS strength FROM m
), verdict AS (
  SELECT source, (k + strength * m) / (n + strength) <= 0.5 AS ok FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


@_query
def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weak_quality.score(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


@_query
def op11_shared_cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.judged(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


@_query
def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op12_winnowing"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  ) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM i)
), dw AS (
  SELECT r, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d JOIN (SELECT DISTINCT k FROM iw) ON len(w) >= k)
), hit AS (
  SELECT r, s, dw.k, item_id FROM dw JOIN iw USING (g, k)
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@_query
def op13_gram_matrix_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))
