"""Training-corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import langid, line_dedup, minhash, mixing, sentencepiece_codec, simhash
from eventide.llm.common import written

#: Documents of which the best language explains a smaller share of the n-grams are in no learned language.
MIN_SCORE = 0.15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; ``lang`` becomes the predicted one.

    Null and empty texts, texts without a letter, and everything where no row has text and a language, are in none and go. Only
    the text decides: repeated rows get equal answers, a null id, source or lang doesn't matter. An empty table gives none.
    """
    train = docs.where(langid.learnable("doc_id"))
    found = langid.predict(docs, train)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share.

    Rows stay as many as they are; a text that loses all its lines is empty, a null one stays null, a null source is no site. Copies of a
    text are one print, so repeated rows lose nothing by their number. An empty table gives none.
    """
    return line_dedup.drop_spread_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 at least.

    Candidates meet by op1's SimHash fingerprints and their covering tables, those beyond its radius by MinHash bands as well; all are verified exactly. The one of the smallest id stays, one row of it if that id repeats with an equal text. Null and blank texts are one group; rows of a
    null id all stay, as nothing names them. Texts are compared whole, whatever their length. An empty table gives none.
    """
    return simhash.keep_representatives(docs, find=minhash.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null texts and texts without words are never taken; a null source is one source, the last; identical rows share their copies
    evenly. Reruns agree. An empty table gives none.
    """
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document.

    A null text has null ids and flags, an empty one no ids; repeated rows get equal ids; very long texts are encoded whole. An empty table gives none.
    """
    return sentencepiece_codec.tokenize(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded", "parity")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Trained filters, XXH64 fingerprints and piece models have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
