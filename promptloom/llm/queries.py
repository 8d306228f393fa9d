"""The dealt operators over their whole tables, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptloom.llm import bpe, leaks, lexical, lines, mixing, near, pages, quality, repeats, secrets, tokens, toxicity, trie
from promptloom.llm.registry import CHECKS, QUERIES, query, table  # noqa: F401


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents", "doc_id", "text"), shingle_words=4)


@query("op4_secret_scans")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents", "doc_id", "text"))


@query("op5_html_extraction")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    return tokens.count_tokens(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_mixing", mixing.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "text", "source"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query("op9_line_dedup", lines.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return lines.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))


@query("op10_decontamination")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark"))


@query("op11_bpe_round_trip")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, folder, "documents", "doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_lexical_search", lexical.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "benchmark"))


@query("op13_conversation_trie", trie.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return trie.build(table(spark, folder, "conversations"))
