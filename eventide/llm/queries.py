"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, cross_polytope, kneser_ney, langid, license_rules, line_dedup, merkle, mixing, sentencepiece_codec, simhash, style_tree, warc, whitening
from .common import shared_folder, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = style_tree.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark_lines(table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(line_dedup.split_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        line_dedup.without_lines(F.col("text"), F.col("removed_lines")).alias("text"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.tokenize(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids", "decoded", "parity")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    found = kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.size("license_sentences").cast("long").alias("n_sentences"),
        F.array_join("license_sentences", ",").alias("sentences"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, docs.where(langid.learnable("doc_id")))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.audit(conversations.damaged(given), given)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.warc_records(pages, "page_id", "url", "html"), folder)
    kind = pages.schema["page_id"].dataType
    found = warc.read_records(spark, folder)
    return found.select(
        F.col("key").cast(kind).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_key").cast(kind).alias("refers_to"),
        "intact",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_source_mixing, op3_embedding_near_dedup, op4_html_extraction, op5_merkle_fingerprints,
        op6_line_dedup, op7_sentencepiece, op8_quality_classifier, op9_license_scan, op10_language_id,
        op11_conversation_repair, op12_embedding_whitening, op13_warc,
    )
}

ORACLES = {"op6_line_dedup": line_dedup.ORACLE_SQL, "op9_license_scan": license_rules.oracle_sql(), "op11_conversation_repair": conversations.ORACLE_SQL, "op13_warc": warc.ORACLE_SQL}
