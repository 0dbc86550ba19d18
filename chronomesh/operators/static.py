"""Static connectivity: one matrix per subject, or one over all subjects' rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.stats import ratio
from chronomesh.operators.edges import finish, pairs
from chronomesh.operators.panel import centred, series


def _pooled(p: DataFrame, pooled: bool) -> DataFrame:
    """With pooled, all subjects' rows make one sample: times become unique over subjects."""
    if not pooled:
        return p
    return p.select(F.lit(0).cast("long").alias("subject"), F.struct("subject", "t").alias("t"), "roi", "x")


def covariance(p: DataFrame, shrinkage: str | None = None, pooled: bool = False, diagonal: bool = False) -> DataFrame:
    """(subject, i, j, w): covariance (ddof 1), or its Ledoit-Wolf shrinkage from sums alone."""
    rows = centred(_pooled(p, pooled))
    sums = pairs(rows, diagonal=True).groupBy("subject", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.count("*").alias("n"))
    if shrinkage is None:
        out = sums.select("subject", "i", "j", ratio(F.col("s"), F.col("n") - 1.0).alias("w"))
    elif shrinkage == "LedoitWolf":
        quartic = rows.groupBy("subject", "t").agg(F.sum(F.col("x") * F.col("x")).alias("q")).groupBy("subject").agg(F.sum(F.col("q") * F.col("q")).alias("b"))
        s = F.col("s") / F.col("n")
        twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
        whole = sums.groupBy("subject").agg(
            F.sum(F.when(F.col("i") == F.col("j"), s)).alias("trace"), F.sum(twice * s * s).alias("d"), F.sum(F.when(F.col("i") == F.col("j"), 1.0)).alias("p"), F.max("n").alias("m")
        )
        whole = whole.join(quartic, "subject").withColumn("mu", F.col("trace") / F.col("p"))
        beta = (F.col("b") / F.col("m") - F.col("d")) / (F.col("m") * F.col("p"))
        delta = (F.col("d") - 2 * F.col("mu") * F.col("trace") + F.col("p") * F.col("mu") * F.col("mu")) / F.col("p")
        whole = whole.select("subject", "mu", F.coalesce(ratio(F.least(beta, delta), delta), F.lit(0.0)).alias("k"))
        w = (1 - F.col("k")) * s + F.when(F.col("i") == F.col("j"), F.col("k") * F.col("mu")).otherwise(0.0)
        out = sums.join(whole, "subject").select("subject", "i", "j", w.alias("w"))
    else:
        raise ValueError(f"unknown shrinkage {shrinkage}")
    return out if diagonal else out.filter("i <> j")


def pearson(p: DataFrame, shrinkage: str | None = None, pooled: bool = False, fisher: bool = False) -> DataFrame:
    """(subject, i, j, w): covariance scaled by both standard deviations; null beside a constant series."""
    cov = covariance(p, shrinkage, pooled, diagonal=True)
    var = cov.filter("i = j").select("subject", F.col("i").alias("k"), F.col("w").alias("v"))
    a, b = var.select("subject", F.col("k").alias("i"), F.col("v").alias("vi")), var.select("subject", F.col("k").alias("j"), F.col("v").alias("vj"))
    scaled = cov.filter("i <> j").join(a, ["subject", "i"]).join(b, ["subject", "j"])
    r = ratio(F.col("w"), F.sqrt(F.col("vi") * F.col("vj")))
    return finish(scaled.select("subject", "i", "j", F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("w")), fisher)


def partial(p: DataFrame, shrinkage: str | None = None, pooled: bool = False) -> DataFrame:
    """(subject, i, j, w): correlation given all other regions, from the inverse covariance.

    Covariances are summed by the engine; only a subject's P x P matrix enters the kernel that inverts it.
    """
    cov = covariance(p, shrinkage, pooled, diagonal=True)
    kind = cov.schema["i"].dataType.simpleString()

    def invert(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["i"]) | set(rows["j"]))
        at = {n: k for k, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for i, j, w in zip(rows["i"], rows["j"], rows["w"]):
            m[at[i], at[j]] = m[at[j], at[i]] = w
        inv = np.linalg.pinv(m)
        d = 1 / np.sqrt(np.diag(inv))
        r = -inv * np.outer(d, d)
        a, b = np.triu_indices(len(names), 1)
        return pd.DataFrame({"subject": rows["subject"].iloc[0], "i": [names[k] for k in a], "j": [names[k] for k in b], "w": r[a, b]})

    return cov.groupBy("subject").applyInPandas(invert, f"subject long, i {kind}, j {kind}, w double")


def mutual_information(p: DataFrame, bins: int = 10, pooled: bool = False) -> DataFrame:
    """(subject, i, j, w): plug-in mutual information in nats over equal-width bins of each series.

    Bins are closed on the left; the largest value falls into a bin of its own (bins + 1). A constant series has one.
    """
    rows = _pooled(p, pooled)
    lo, hi = F.min("x").over(series()), F.max("x").over(series())
    width = (hi - lo) / bins
    at = F.when(hi == lo, F.lit(1)).when(F.col("x") == hi, F.lit(bins + 1)).otherwise(F.least(F.lit(bins), 1 + F.floor((F.col("x") - lo) / F.when(width != 0, width)))).cast("int")
    counts = pairs(rows.withColumn("x", at)).groupBy("subject", "i", "j", "x", "y").agg(F.count("*").cast("double").alias("n"))
    whole = Window.partitionBy("subject", "i", "j")
    n = F.sum("n").over(whole)
    px, py = F.sum("n").over(Window.partitionBy("subject", "i", "j", "x")) / n, F.sum("n").over(Window.partitionBy("subject", "i", "j", "y")) / n
    parts = counts.select("subject", "i", "j", (F.col("n") / n).alias("pxy"), px.alias("px"), py.alias("py"))
    return parts.groupBy("subject", "i", "j").agg(F.sum(F.col("pxy") * F.ln(F.col("pxy") / (F.col("px") * F.col("py")))).alias("w"))
