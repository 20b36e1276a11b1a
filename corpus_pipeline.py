"""A training-data pipeline over ``documents``: language, quality, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir); ``run`` writes each result as Parquet to the shared folder
and reads it again for the next stage.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import langid, ngram_join, packing, quality, secrets
from tributary.llm._shared import Scratch
from tributary.llm.queries import vocabulary

#: A text is rejected as no language where coding it costs this many bits a byte even in the best one.
MOST_BITS = 7.0


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; rejects texts without a letter, and noise that no language's model compresses.

    The language column stays as it is given; where it is null the predicted one is filled in.
    """
    named = langid.predict(docs, langid.train(docs))
    kept = named.where((F.col("lang_pred") != "und") & (F.coalesce("bits_per_byte", F.lit(0.0)) <= MOST_BITS))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, learned from the labels, scores 0.5 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    Rows of one id are one document, and different texts of it stay together; of equal rows one stays.
    Rows without an id are in no group and all stay.
    """
    groups = ngram_join.join(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null")).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; all documents stay."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 2048: a row per piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id"])


STAGES = [("language", by_language), ("quality", by_quality), ("near_copies", without_near_copies), ("secrets", without_secrets), ("packing", packed)]

#: Trained models and the tokenizer are beyond SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
