"""Queries of the operators of this folder, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import (
    alignment, covertree, decontaminate, kneserney, licences, mixing, prefixes, quality, secrets, simhash,
    suffixes, tokenbin, urls)
from meterline.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    features = quality.judge(docs)
    return features.select(
        "row.doc_id", *quality.COUNTS, *quality.FEATURES, "base_failed", "kept")


def op2_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn(
        "held_out", F.expr("coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)"))
    model = kneserney.fit(docs.where("not held_out").select("text"))
    scored = docs.select("doc_id", "held_out", kneserney.scorer(model)("text").alias("s"))
    return scored.select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score",
        kneserney.perplexity(F.col("s.score"), F.col("s.n_tokens")).alias("perplexity"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_tokenizer() -> str:
    return tokenizer_file("word_bpe_49k.json")


def op3_token_binary(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return tokenbin.read_documents(tokenbin.write(docs, word_tokenizer()))


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf, "documents"), with_text=False).drop("kept_text")
    return cut.withColumn("has_repeats", F.col("n_removed") > 0)


def op5_licences(spark: SparkSession, sf: str) -> DataFrame:
    found = licences.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_paragraphs", "n_cued", "n_licensed",
                        F.array_join("families", ",").alias("families"))


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return simhash.classes(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    judged = decontaminate.judge(docs, table(spark, sf, "benchmark"))
    return judged.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", *[secrets.count_of(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.spelled(secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.spelled().alias("spans"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    host, _ = urls.host_and_path(F.col("url"))
    labelled = pages.select("url", urls.known_bad(host).alias("label"))
    judged = urls.judge(pages, labelled)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", F.round("p_bad", 6).alias("p_bad"))


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.align(
        table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"),
        tokenizer_file("piece_bpe_32k.model"), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        "groups_sha256", "n_overlaps")


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefixes.trie(table(spark, sf, "conversations"))


def op13_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_kneser_ney": op2_kneser_ney,
        "op3_token_binary": op3_token_binary,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_licences": op5_licences,
        "op6_simhash": op6_simhash,
        "op7_mixing": op7_mixing,
        "op8_decontamination": op8_decontamination,
        "op9_secrets": op9_secrets,
        "op10_url_filter": op10_url_filter,
        "op11_token_alignment": op11_token_alignment,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_embedding_dedup": op13_embedding_dedup,
    }
