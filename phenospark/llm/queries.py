"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from phenospark.llm import ann, bpe, chat, htmltext, jaccard, langid, mixing, quality, repair, substrings, tokencount, toxicity, whitening
from phenospark.llm.common import prepare, read
from phenospark.runtime import materialize


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_components(read(spark, folder, "documents").select("doc_id", "text"))


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    texts = htmltext.extract(pages, htmltext.fit(pages)).drop("html")
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    measured = materialize(quality.rule_counts(docs).drop("text"), "measured")
    return quality.judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed"
    )


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, folder, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def op5_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, folder, "documents").select("doc_id", "text")
    shared = tokencount.share_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    counted = tokencount.count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")), shared)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = substrings.remove_repeats(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    # the contract asks for this conversation beside the table's
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    return chat.digests(chat.chat_windows(turns.unionByName(extra)))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, folder, "documents").select("doc_id", "text")
    shared = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, shared, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(encoded, shared, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held = toxicity.held_out(F.col("doc_id"))
    languages = langid.fit(docs.where(~held).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), languages)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(turns)).conversations.drop("n")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    whitened = whitening.whiten(read(spark, folder, "embeddings").select("vec_id", "embedding"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_html_text": op2_html_text,
    "op3_quality_rules": op3_quality_rules,
    "op4_mix_sources": op4_mix_sources,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat_windows": op8_chat_windows,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_language_id": op11_language_id,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}
