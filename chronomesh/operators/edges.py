"""Pairs of regions and the finishing steps that all matrices share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.stats import fisher_z

PAIR = ["i", "j"]


def packed(p: DataFrame, *values: str) -> DataFrame:
    """One row per (subject, t): v, the regions' values as an array of structs in order of region."""
    return p.groupBy("subject", "t").agg(F.array_sort(F.collect_list(F.struct("roi", *values))).alias("v"))


def pairs(p: DataFrame, value: str = "x", diagonal: bool = False) -> DataFrame:
    """(subject, t, i, j, x, y) for i < j (or i <= j): one shuffle packs a time's regions, pairs are made within the row."""
    first = 1 if diagonal else 2
    made = f"flatten(transform(v, (a, k) -> transform(slice(v, k + {first}, size(v)), b -> struct(a.roi as i, b.roi as j, a.{value} as x, b.{value} as y))))"
    return packed(p, value).select("subject", "t", F.expr(f"inline({made})"))


def finish(edges: DataFrame, fisher: bool = False) -> DataFrame:
    """Fisher z of w, if asked for; values of the diagonal are never transformed as they are not stored."""
    return edges.withColumn("w", fisher_z(F.col("w"))) if fisher else edges


def mirrored(edges: DataFrame, diagonal: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Both directions of each edge, and with nodes also rows (i, i, diagonal)."""
    keys = [c for c in edges.columns if c not in ("i", "j", "w")]
    both = edges.select(*keys, "i", "j", "w").unionByName(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    if nodes is None:
        return both
    own = (edges.select(*keys).distinct().crossJoin(nodes) if keys else nodes).select(*keys, "i", F.col("i").alias("j"), (F.lit(0.0) if diagonal is None else diagonal).cast("double").alias("w"))
    return both.unionByName(own)


def lower_triangle(edges: DataFrame) -> DataFrame:
    """Each pair as (i, j) with i > j; zeros are kept."""
    keys = [c for c in edges.columns if c not in ("i", "j", "w")]
    return edges.select(*keys, F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "w").filter("i <> j")


def edge_series(p: DataFrame, standardised: bool = True) -> DataFrame:
    """(subject, t, i, j, w): products of the regions' z-scores (ddof 1) at each time."""
    from chronomesh.operators.panel import standardise

    return pairs(standardise(p, 1) if standardised else p).select("subject", "t", *PAIR, (F.col("x") * F.col("y")).alias("w"))


def edge_rms(series: DataFrame) -> DataFrame:
    """(subject, t, rms): root mean square over the edges."""
    return series.groupBy("subject", "t").agg(F.sqrt(F.avg(F.col("w") * F.col("w"))).alias("rms"))


def edge_labels(series: DataFrame) -> DataFrame:
    """(i, j, label) of the edges, `i–j`."""
    return series.select(*PAIR).distinct().withColumn("label", F.concat(F.col("i").cast("string"), F.lit("–"), F.col("j").cast("string")))


def edge_connectivity(series: DataFrame) -> DataFrame:
    """(subject, i1, j1, i2, j2, w): cosine of two edges' series, for each unordered pair of edges."""
    from chronomesh.functions.stats import ratio

    v = series.groupBy("subject", "t").agg(F.array_sort(F.collect_list(F.struct("i", "j", "w"))).alias("v"))
    made = "flatten(transform(v, (a, k) -> transform(slice(v, k + 2, size(v)), b -> struct(a.i as i1, a.j as j1, b.i as i2, b.j as j2, a.w as x, b.w as y))))"
    rows = v.select("subject", F.expr(f"inline({made})"))
    top = F.sum(F.col("x") * F.col("y"))
    return rows.groupBy("subject", "i1", "j1", "i2", "j2").agg(ratio(top, F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("w"))
