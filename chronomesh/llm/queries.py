"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import langid, licenses, media, mixing, orderminhash, packing, secrets, simhash, substrings, toxicity
from chronomesh.llm.common import documents


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op2_orderminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.edit_sensitivity(documents(spark, sf_dir))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_orderminhash": op2_orderminhash,
    "op3_substrings": op3_substrings,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substrings": substrings.oracle_sql(),
    "op5_mixing": mixing.oracle_sql(),
    "op8_licenses": licenses.oracle_sql(),
}
