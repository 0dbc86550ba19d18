"""Phase-based connectivity: analytic signals, phase synchrony, leading eigenvectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.operators.edges import pairs


def analytic_phase(p: DataFrame) -> DataFrame:
    """(subject, t, roi, phase): angle of each series' analytic signal, by one FFT per series; no demeaning first."""
    kind = p.schema["roi"].dataType.simpleString()

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x = rows["x"].to_numpy(float)
        n = len(x)
        keep = np.zeros(n)
        keep[0] = 1
        keep[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            keep[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x) * keep)
        return pd.DataFrame({"subject": rows["subject"], "t": rows["t"], "roi": rows["roi"], "phase": np.arctan2(z.imag, x)})

    return p.groupBy("subject", "roi").applyInPandas(transform, f"subject long, t long, roi {kind}, phase double")


def phase_synchronisation(p: DataFrame, method: str = "crp") -> DataFrame:
    """(subject, t, i, j, w): crp cos(d), phcoh 1 - |sin d|, teneto 1 - sin(|d| / 2) of the phase difference d."""
    d = F.col("x") - F.col("y")
    forms = {"crp": F.cos(d), "phcoh": 1 - F.abs(F.sin(d)), "teneto": 1 - F.sin(F.abs(d) / 2)}
    if method not in forms:
        raise ValueError(f"unknown method {method}")
    return pairs(analytic_phase(p), "phase").select("subject", "t", "i", "j", forms[method].alias("w"))


def leading_eigenvectors(p: DataFrame, flip: bool = True) -> DataFrame:
    """(subject, t, roi, v): leading eigenvector of the matrix cos(phase_i - phase_j) at each time.

    The matrix has rank two, c c' + s s' with c = cos, s = sin of the phases, so the vector is a c + b s with a and b
    from a 2 x 2 matrix: window sums instead of an eigendecomposition. flip: negated if over half of it is positive.
    """
    at = Window.partitionBy("subject", "t")
    cs = analytic_phase(p).select("subject", "t", "roi", F.cos("phase").alias("c"), F.sin("phase").alias("s"))
    cs = cs.withColumns({"a": F.sum(F.col("c") * F.col("c")).over(at), "b": F.sum(F.col("c") * F.col("s")).over(at), "d": F.sum(F.col("s") * F.col("s")).over(at)})
    lam = (F.col("a") + F.col("d") + F.sqrt((F.col("a") - F.col("d")) ** 2 + 4 * F.col("b") ** 2)) / 2
    even = F.abs(F.col("b")) < 1e-12
    raw = F.when(even & (F.col("a") >= F.col("d")), F.col("c")).when(even, F.col("s")).otherwise((lam - F.col("d")) * F.col("c") + F.col("b") * F.col("s"))
    v = cs.withColumn("v", raw).withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(at)))
    if flip:
        v = v.withColumn("v", F.when(F.avg((F.col("v") > 0).cast("double")).over(at) > 0.5, -F.col("v")).otherwise(F.col("v")))
    return v.select("subject", "t", "roi", "v")


def leida(p: DataFrame, flip: bool = True) -> DataFrame:
    """(subject, t, i, j, w): outer products of the leading eigenvectors."""
    return pairs(leading_eigenvectors(p, flip), "v").select("subject", "t", "i", "j", (F.col("x") * F.col("y")).alias("w"))
