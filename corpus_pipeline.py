"""A corpus pipeline: five stages over `documents`, each working on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointproc.llm import mixing, ngram_join, sentencepieces, suffixes, toxicity
from pointproc.llm.common import table
from pointproc.session import store


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity stays."""
    return ngram_join.one_of_each(docs)


def repeated_bytes_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; n_chars follows the text."""
    cut = suffixes.without_spans(docs, suffixes.removed_spans(docs))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row of the mix."""
    ids = sentencepieces.encode(docs)
    return ids.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic_out), ("ngram_join", near_copies_out), ("suffix_dedup", repeated_bytes_out),
          ("source_mix", mixed), ("sentencepiece", encoded)]

#: The stages learn, hash and encode: their rows are checked against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, what each keeps written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
