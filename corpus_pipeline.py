"""A corpus from raw documents to tokens, in stages that each call one operator of graphloom.llm.

Every stage works on all that the one before it kept, and returns the columns of
documents, but for the last, which returns each document's ids. Between stages the
documents are written as Parquet in the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, langid, neardup, pii
from graphloom.llm.common import held_out, read, stored
from graphloom.llm.queries import tokenizer_config

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (a null text, or one without a letter) go; a missing lang is filled in."""
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return neardup.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is nothing else goes."""
    return _documents(decontam.remove(docs, read(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return _documents(pii.redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, packed as little-endian 32-bit integers, and the digests of ids and decoded text."""
    made = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_config())
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]
ORACLE_SQL = None
"""SQL cannot express these stages; tests/llm holds them against brute-force versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
