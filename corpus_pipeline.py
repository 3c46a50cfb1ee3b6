"""Corpus pipeline: documents through the stages below, each written as Parquet and read again.

Every stage is one operator of ``babelscore.llm`` applied to all that the stage before it kept. All
stages but the last return the columns of ``documents``, whatever their names. Repeated rows and null
ids are judged as they come: a decision about an id holds for all rows with that id and text; of equal
rows of one id the near-duplicate stage keeps one, wordless ones too (those go before it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from babelscore.llm import decontam, jaccard_join, langid, secrets, subword
from babelscore.session import prepare, scratch_path, table_path

LEAST_SCORE = 0.5  # of the language prediction


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no recognised language go: no letters, or no language likelier than not."""
    prepare(spark)
    return langid.recognised(docs, least=LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (one row of it)."""
    prepare(spark)
    return jaccard_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    prepare(spark)
    benchmark = spark.read.parquet(table_path(sf_dir, "benchmark"))
    return decontam.clean(docs, benchmark)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; every document stays."""
    prepare(spark)
    return secrets.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text again."""
    prepare(spark)
    return subword.encode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secret_redaction), ("encoding", encoding)]

# The language model, the classes it picks and the token ids have no SQL form; tests/llm holds the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
