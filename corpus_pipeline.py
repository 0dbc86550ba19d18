"""Corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.llm import langid, mixing, nearcopies, packing, secrets
from chronomesh.llm.common import NULL_ID, documents, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A document of a lower language score is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with enough certainty; the model is fitted on rows that name a language."""
    return langid.accept(docs, langid.fit(docs.filter("lang is not null")), LEAST_LANGUAGE_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest doc_id, null first, then the smallest hash of the text.

    Rows are told apart by doc_id and text, so different texts under a null or repeated doc_id each count. Of rows equal
    in both the least by the other columns stays.
    """
    found = nearcopies.near_copies(docs.select("doc_id", "text"))
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("least")).select(F.col("least.doc_id").alias("__near_id"), F.col("least.content").alias("__near_text"))
    keyed = docs.withColumns({"__near_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__near_text": F.xxhash64(F.col("text").cast("string"))})
    keyed = keyed.join(kept.hint("shuffle_merge"), ["__near_id", "__near_text"], "left_semi")
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy("__near_id", "__near_text").orderBy(*(others or [F.lit(0)]))
    return keyed.withColumn("__near_row", F.row_number().over(one)).filter("__near_row = 1").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn so that token weights meet the target marginals."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("pack", pack),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
