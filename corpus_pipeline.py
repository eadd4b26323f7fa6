"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Rows with a null doc_id pass the filtering stages unless their own text speaks against them; rows
that share a doc_id stay or go together where documents are compared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.llm import ngram_join, packing, secrets, substrings, toxicity
from trailmix.llm.common import shipped, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score predicts as toxic go."""
    shipped(spark)
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by n-gram similarity (0.8 on five words) the document of the smallest id stays; texts without words are in no group."""
    shipped(spark)
    found = ngram_join.linked(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut; a document goes if nothing of it is left. Others keep their text as it was."""
    shipped(spark)
    found = substrings.deduplicated(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    return _with_text(found, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark."""
    return _with_text(secrets.scan(docs.select(*COLUMNS)), secrets.redacted(F.col("text"), F.col("found")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    shipped(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("substring_dedup", remove_repeats),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: A learnt score, a graph closure and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
