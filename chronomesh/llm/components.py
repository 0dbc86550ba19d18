"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import stored, temporary


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """For each (u, v): the smallest v of that u beside it. An aggregate joined back, so a hot u is combined early and split by AQE."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = _to_minimum(edges)
    kept = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionAll(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node on an edge (u, v), root being the smallest node that it is linked to; roots are listed too.

    Edges are undirected 64-bit ids. Null ends and loops are left out; repeated edges count once; no edges give no rows.
    Each round is written to the shared folder, so lineage stays short, and all rounds but the last are deleted.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    with temporary(edges.sparkSession):
        edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        seen = None
        while True:
            edges = stored(_small_star(_large_star(edges)), "edges")
            sign = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
            if (sign.n, sign.x) == seen:
                break
            seen = (sign.n, sign.x)
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots).distinct()
        found = stored(found, "components", result=True)
    return found
