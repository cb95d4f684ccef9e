"""From raw documents to token ids: toxicity, near duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, whatever they are. A stage works on all rows that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreeline.llm import bpe, jaccard, mixing, pii, toxicity
from agreeline.llm.common import bounded, cut, fresh, new_path

#: Documents that score at least so much are rejected.
TOXIC = 0.5
VOCABULARY = "byte_bpe_50k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; all others stay, unlabelled and empty ones too. Each
    row is judged by its own text, also where rows share an id or have none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    row, bad = fresh(docs, "row", "bad")
    named = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    scores = toxicity.score(named, labels, keep=(row,))
    rejected = scores.filter(F.col("score") >= TOXIC).select(F.col(row).alias(bad)).distinct()
    return named.join(bounded(rejected), F.col(row) == F.col(bad), "left_anti").drop(row)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, stays of each group that five-word shingles with a
    Jaccard similarity of 0.8 or more link; of rows with one doc_id and one text, one stays. Rows
    without a doc_id stay, since nothing tells which document they are."""
    (mark,) = fresh(docs, "mark")
    groups = cut(jaccard.jaccard_components(docs, n=5, num=80, den=100))
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(mark)).distinct()
    kept = docs.join(bounded(gone), F.col("doc_id") == F.col(mark), "left_anti")
    again = cut(groups.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(mark)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(mark))
    if again.isEmpty():
        return kept
    again = bounded(again)
    once = kept.join(again, F.col("doc_id") == F.col(mark), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, F.col("doc_id") == F.col(mark), "left_anti").unionByName(once)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid personal numbers, dates and addresses become pseudonyms of their format; the secret is the
    session's."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, dealt to shards and shuffled."""
    return mixing.draw(docs, mixing.mix(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row of the mix."""
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL has no Viterbi decoding, pseudonyms or merges; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
