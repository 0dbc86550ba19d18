"""Writers of panels, matrices and multiverse results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.operators.multiverse import decisions_of


def write_panel(panel: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by subject, so that per-subject reads are pruned."""
    panel.repartition("subject").write.mode(mode).partitionBy("subject").parquet(path)


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.repartition("subject").write.mode(mode).partitionBy("subject").parquet(path)


def write_summary(space: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The wide summary as CSV: Universe, Decision i, Value i, .."""
    names = decisions_of(space)
    columns = [c for k, d in enumerate(names, 1) for c in (F.lit(d).alias(f"Decision {k}"), F.col(f"`{d}`").alias(f"Value {k}"))]
    space.orderBy("universe").select(F.col("universe").alias("Universe"), *columns).coalesce(1).write.mode(mode).csv(path, header=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The space back from write_summary(); the decisions' names come from the first row."""
    wide = spark.read.csv(path, header=True)
    first = wide.first()
    if first is None:
        raise ValueError(f"no summary at {path}")
    k = sum(c.startswith("Decision ") for c in wide.columns)
    return wide.select(F.col("Universe").cast("long").alias("universe"), F.lit(0).alias("order_id"), *[F.col(f"Value {i}").alias(first[f"Decision {i}"]) for i in range(1, k + 1)])


def save_universe_results(results: DataFrame, path: str) -> None:
    """Append (universe, measure, value) rows; one dataset holds all universes, so nothing needs to be combined later."""
    results.write.mode("append").parquet(path)


def load_multiverse(spark: SparkSession, summary: str, results: str) -> tuple[DataFrame, DataFrame]:
    """(space, results) from their paths. A missing path raises an error; nothing is deleted."""
    return read_summary(spark, summary), spark.read.parquet(results)
