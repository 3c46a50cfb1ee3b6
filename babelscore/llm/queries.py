"""Registered queries of this folder: each applies one operator to its whole table and returns the
contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, table_path
from . import chat, collocations, conversation_trie, decontam, html_text, jaccard_join, langid, quality_crf, quality_rules, secrets, substring_dedup, subword, token_files


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def digest_spans(df: DataFrame, spans: str, kinds=None):
    """kind:start:end of the spans (of some kinds), comma-joined in their order."""
    kept = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(read(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts,
                        F.sha2(digest_spans(found, "spans", secrets.BASE_KINDS), 256).alias("base_sha256"),
                        digest_spans(found, "spans").alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removed_words(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = langid.identify(documents.select("doc_id", "text"), langid.train(documents))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(read(spark, sf_dir, "conversations"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = quality_crf.score(documents, quality_crf.train(documents, read(spark, sf_dir, "labels")))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.encode(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(read(spark, sf_dir, "conversations")).drop("k1", "k2")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), path, metadata=("lang", "source"))
    return token_files.with_checksum(token_files.read(spark, path))


def queries() -> dict:
    return {
        "op1_secrets": op1_secrets,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_html_text": op3_html_text,
        "op4_quality_rules": op4_quality_rules,
        "op5_langid": op5_langid,
        "op6_chat": op6_chat,
        "op7_quality_crf": op7_quality_crf,
        "op8_decontam": op8_decontam,
        "op9_subword": op9_subword,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_collocations": op12_collocations,
        "op13_token_files": op13_token_files,
    }
