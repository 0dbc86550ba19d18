"""Time-resolved connectivity: windows, jackknife, derivatives, spatial distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.stats import corr_from_sums, ratio
from chronomesh.operators.edges import finish, pairs
from chronomesh.operators.panel import centred

SUMS = ["sx", "sy", "sxy", "sxx", "syy"]


def taper(shape: str, size: int, std: float = 10.0) -> Column:
    """Weight of place `o` (0-based) in a window."""
    o = F.col("o")
    if shape == "rectangular":
        return F.lit(1.0)
    if shape == "gaussian":
        return F.exp(F.lit(-0.5) * F.pow((o - F.lit((size - 1) / 2)) / F.lit(float(std)), F.lit(2.0)))
    if shape == "hamming":
        return F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(6.283185307179586) * o / F.lit(float(max(size - 1, 1))))
    raise ValueError(f"unknown window shape {shape}")


def _terms(weight: Column) -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [weight.alias("n"), (weight * x).alias("sx"), (weight * y).alias("sy"), (weight * x * y).alias("sxy"), (weight * x * x).alias("sxx"), (weight * y * y).alias("syy")]


def _corr() -> Column:
    return corr_from_sums(*(F.col(c) for c in ["n", *SUMS]))


def _running(rows: DataFrame, size: int, step: int) -> DataFrame:
    """Sums over t..t + size - 1 for every window start t = k * step; one row per pair and time, no rows are repeated."""
    over = Window.partitionBy("subject", "i", "j").orderBy("t").rowsBetween(0, size - 1)
    made = rows.select("subject", "i", "j", "t", *_terms(F.lit(1.0)))
    sums = [F.sum(c).over(over).alias(c) for c in ["n", *SUMS]]
    first = F.min("t").over(Window.partitionBy("subject", "i", "j"))
    made = made.select("subject", "i", "j", (F.col("t") - first).alias("start"), *sums)
    return made.filter((F.col("n") == size) & (F.col("start") % step == 0)).withColumn("t", (F.col("start") / step).cast("long")).drop("start")


def sliding_window(p: DataFrame, size: int = 29, step: int = 1, shape: str = "rectangular", std: float = 10.0, fisher: bool = False) -> DataFrame:
    """(subject, t, i, j, w): weighted correlation in each window t = 0..(T - size) // step; null where a series is constant.

    Rectangular windows are running sums over each pair's series. Tapered ones list each time's windows (at most
    size / step) and are summed with map-side partial sums. Times of a subject must be consecutive.
    """
    rows = pairs(centred(p))
    if shape == "rectangular":
        sums = _running(rows, size, step)
    else:
        last = F.max("t").over(Window.partitionBy("subject", "i", "j"))
        at = rows.withColumn("last", last)
        first_k = F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / F.lit(float(step)))).cast("long")
        last_k = F.least(F.floor(F.col("t") / F.lit(float(step))), F.floor((F.col("last") + 1 - size) / F.lit(float(step)))).cast("long")
        in_window = at.withColumn("k", F.explode(F.when(first_k <= last_k, F.sequence(first_k, last_k)).otherwise(F.array().cast("array<bigint>"))))
        terms = in_window.withColumn("o", (F.col("t") - F.col("k") * step).cast("double")).select("subject", "i", "j", F.col("k").alias("t"), *_terms(taper(shape, size, std)))
        sums = terms.groupBy("subject", "i", "j", "t").agg(*[F.sum(c).alias(c) for c in ["n", *SUMS]])
    return finish(sums.select("subject", "t", "i", "j", _corr().alias("w")), fisher)


def centres(p: DataFrame, size: int, step: int = 1) -> DataFrame:
    """(subject, t, centre): the middle time of each window."""
    spans = p.groupBy("subject").agg((F.max("t") + 1).alias("n")).filter(F.col("n") >= size)
    k = F.posexplode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - size) / step).cast("long")))
    return spans.select("subject", k).select("subject", F.col("col").alias("t"), (F.col("col") * step + size // 2).alias("centre"))


def jackknife(p: DataFrame, size: int = 1, step: int = 1, fisher: bool = False) -> DataFrame:
    """(subject, t, i, j, w): minus the correlation of all times but a window's: whole sums less running sums."""
    rows = pairs(centred(p))
    whole = rows.select("subject", "i", "j", *_terms(F.lit(1.0))).groupBy("subject", "i", "j").agg(*[F.sum(c).alias(f"all_{c}") for c in ["n", *SUMS]])
    left = _running(rows, size, step).join(whole, ["subject", "i", "j"])
    rest = left.select("subject", "t", "i", "j", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ["n", *SUMS]])
    return finish(rest.select("subject", "t", "i", "j", (-_corr()).alias("w")), fisher)


def temporal_derivatives(p: DataFrame, size: int = 7) -> DataFrame:
    """(subject, t, i, j, w): moving mean of products of the series' scaled first differences, for complete windows."""
    series = Window.partitionBy("subject", "roi")
    d = p.withColumn("x", F.col("x") - F.lag("x").over(series.orderBy("t"))).filter("x is not null")
    d = d.withColumn("x", ratio(F.col("x"), F.stddev_pop("x").over(series)))
    over = Window.partitionBy("subject", "i", "j").orderBy("t").rowsBetween(0, size - 1)
    made = pairs(d).select("subject", "i", "j", "t", F.avg(F.col("x") * F.col("y")).over(over).alias("w"), F.count("*").over(over).alias("n"))
    return made.filter(F.col("n") == size).select("subject", (F.col("t") - 1).alias("t"), "i", "j", "w")


DISTANCES = {
    "euclidean": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))",
    "cityblock": "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, v) -> s + v)",
    "cosine": "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v) * aggregate(b, 0D, (s, v) -> s + v * v)), 0D)",
}


def distance_weights(p: DataFrame, distance: str = "euclidean") -> DataFrame:
    """(subject, t, s, weight): inverse distances of a subject's times, scaled to 0..1 over all pairs; 1 of a time to itself.

    Times that are equal have no inverse distance and make the subject's weights null, save at themselves.
    """
    rows = p.groupBy("subject", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("roi", "x"))), lambda s: s["x"]).alias("a"))
    other = rows.select("subject", F.col("t").alias("s"), F.col("a").alias("b"))
    g = rows.join(other, "subject").filter("t < s").select("subject", "t", "s", F.expr(f"1D / nullif({DISTANCES[distance]}, 0D)").alias("g"))
    whole = Window.partitionBy("subject")
    bad = F.max(F.col("g").isNull().cast("int")).over(whole) == 1
    low, high = F.min("g").over(whole), F.max("g").over(whole)
    half = g.select("subject", "t", "s", F.when(~bad, ratio(F.col("g") - low, high - low)).alias("weight"))
    own = rows.select("subject", "t", F.col("t").alias("s"), F.lit(1.0).alias("weight"))
    return half.unionByName(half.select("subject", F.col("s").alias("t"), F.col("t").alias("s"), "weight")).unionByName(own)


def spatial_distance(p: DataFrame, distance: str = "euclidean") -> DataFrame:
    """(subject, t, i, j, w): correlation over all times weighted by their nearness to t; quadratic in a subject's times."""
    weights = distance_weights(p, distance)
    bad = weights.filter("weight is null").select("subject").distinct()
    rows = pairs(centred(p)).withColumnRenamed("t", "s")
    terms = rows.join(weights, ["subject", "s"]).select("subject", "i", "j", "t", *_terms(F.col("weight")))
    sums = terms.groupBy("subject", "i", "j", "t").agg(*[F.sum(c).alias(c) for c in ["n", *SUMS]])
    flagged = sums.join(bad.withColumn("bad", F.lit(True)), "subject", "left")
    return flagged.select("subject", "t", "i", "j", F.when(F.col("bad").isNull(), _corr()).alias("w"))
