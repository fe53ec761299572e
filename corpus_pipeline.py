"""A training corpus out of documents, in five stages.

Each stage works on all that the one before kept, written as Parquet and read again.
Stages take rows as they are: null and repeated doc_ids are kept apart by their texts, null
texts are empty ones, further columns pass through (the last stage has its own), and an
empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxflow.llm import langid, packing, pii, simhash, suffix_dedup
from luxflow.llm.common import read_table, written


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where they have it, as the length of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without letters, null texts among them, and those of which no language is likelier than not. Without labelled rows to learn from all stay."""
    return langid.keep_known(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one of smallest doc_id; rows without an id come last. Rows equal in all columns are one."""
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of 50 words that still occur more than once go; documents of which nothing is left go with them. Empty and null texts stay."""
    return recounted(suffix_dedup.clean(docs, words=50))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null texts stay null."""
    return recounted(pii.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their places in training sequences; a null text is one end id."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("pii", redact_pii), ("best_fit_packing", best_fit_packing)]

#: SQL can't express trained classifiers, components of fingerprints and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
