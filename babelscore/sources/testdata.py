"""Input tables derived from the generated test data (same derivation as the SQL oracle).

``wide``: documents numbered per language by id, one column per language, one row per number.
``annotated``: events as a category / confidence-string table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_within_groups
from ..operators.reshape import pivot_to_wide
from ..session import table_path

# Fixture mapping from document language codes to wide-table columns (no Italian on purpose).
DOC_LANGUAGE_COLUMNS = {"en": "English", "es": "Spanish", "fr": "French", "de": "German"}
# Categories the reports list for the events-based annotated fixture ('refund' never occurs,
# 'view' occurs but is not listed).
EVENT_CATEGORIES = ["click", "error", "purchase", "signup", "refund"]
# Every this-many-th event carries an unparseable confidence.
UNPARSEABLE_EVERY = 50


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def wide_from_documents(spark: SparkSession, sf_dir: str, **numbering) -> DataFrame:
    """``sentence_id bigint, English, Spanish, French, German``; trailing cells of the smaller
    languages are null."""
    docs = (read_table(spark, sf_dir, "documents")
            .select("doc_id", "lang", "text")
            .filter(F.col("lang").isin(list(DOC_LANGUAGE_COLUMNS))))
    numbered = number_within_groups(docs, "lang", "doc_id", out="rn", **numbering)
    wide = pivot_to_wide(numbered, "rn", "lang", "text", DOC_LANGUAGE_COLUMNS)
    return wide.select(F.col("rn").alias("sentence_id"), *DOC_LANGUAGE_COLUMNS.values())


def annotated_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``final_category string, Confidence string`` with some unparseable cells."""
    ev = read_table(spark, sf_dir, "events")
    conf = (F.when(F.col("event_id") % UNPARSEABLE_EVERY == 0, F.lit("n/a"))
            .otherwise(F.col("value").cast("string")))
    return ev.select(F.col("event_type").alias("final_category"), conf.alias("Confidence"))
