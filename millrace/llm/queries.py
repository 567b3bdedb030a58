"""Registered queries of the operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat, cross_tokens, decontaminate, fingerprint, hard_negatives, html_crf, licenses, neardup, orc_ids, packing, quality, substring, warc,
)
from millrace.llm.tokens import vocabulary
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
PACK_VOCABULARY, PACK_END = "word_bpe_49k.json", 2
ORC_VOCABULARY, ORC_END = "byte_bpe_50k.json", 0
CROSS_A, CROSS_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CONFLICT = r"\### Assistant: </turn> ok"


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"], matches=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, folder, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.to_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.to_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "inside_next", "n_shingles",
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    model = quality.train(labelled.filter(~quality.held_out()))
    return quality.score(docs, model, carry=["doc_id"]).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=4)


def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, folder, "documents"), carry=["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    written = warc.write_archives(warc.with_revisits(table(spark, folder, "pages")))
    return warc.read_archives(warc.normalise_archives(written)).drop("payload", "url")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(PACK_VOCABULARY), PACK_END, with_ids=False)


def op9_orc_ids(spark: SparkSession, folder: str) -> DataFrame:
    files = orc_ids.write_ids(table(spark, folder, "documents"), vocabulary(ORC_VOCABULARY), ORC_END)
    return orc_ids.read_digests(spark, files)


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_crf.main_text(pages, html_crf.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.whole_vectors(table(spark, folder, "embeddings"), label=label), F.col("vec_id") % 50 == 0)


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_base", F.col("first_base").alias("first_word"), F.col("last_base").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op13_cross_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return cross_tokens.align_documents(table(spark, folder, "documents"), vocabulary(CROSS_A), vocabulary(CROSS_B))


REGISTRY: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_fingerprints, op3_quality, op4_near_duplicates, op5_repeated_passages,
        op6_chat, op7_warc, op8_packing, op9_orc_ids, op10_main_text, op11_hard_negatives, op12_licenses, op13_cross_tokens,
    )
}
