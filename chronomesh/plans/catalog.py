"""All registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.plans import q_graph, q_multiverse, q_panel, q_sources, q_states, q_streaming  # noqa: F401
from chronomesh.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
