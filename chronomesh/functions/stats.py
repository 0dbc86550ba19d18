"""Column expressions shared by the estimators. None of them fails on constant data: they give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is zero."""
    return top / F.when(bottom != 0, bottom)


def clean_zero(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def corr_from_sums(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column, tiny: float = 1e-12) -> Column:
    """Pearson correlation from (weighted) sums, within [-1, 1]; null if either variance is (numerically) zero."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    floor_x, floor_y = F.lit(tiny) * n * sxx, F.lit(tiny) * n * syy
    r = (n * sxy - sx * sy) / F.sqrt(vx * vy)
    return F.when((vx > floor_x) & (vy > floor_y), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fisher_z(r: Column) -> Column:
    return F.atanh(F.greatest(F.lit(-1.0 + EPS), F.least(F.lit(1.0 - EPS), r)))


def significant(x: Column, digits: int) -> Column:
    """x rounded to a number of significant figures; zero stays."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def exact_medians(rows: DataFrame, keys: list[str], x: str, margin: float = 0.002) -> DataFrame:
    """(keys.., median) of finite numbers, however many a group holds.

    An approximate pass brackets each group's middle. Only what lies within the bracket, some thousandths of a group, is
    put in order; what lies below is counted in the same pass, since another pass would find other brackets. Groups are few:
    their brackets are one row each. rows are read twice and must be the same both times.
    """
    value = F.col(x).cast("double")
    near = F.percentile_approx(value, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), F.lit(10_000))
    brackets = rows.filter(value.isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), near.alias("_b"))
    marked = rows.filter(value.isNotNull()).join(brackets, keys).withColumn("_v", value).filter(F.col("_v") <= F.col("_b")[1])
    # one row of each group is null: all that lies below
    counted = marked.withColumn("_v", F.when(F.col("_v") >= F.col("_b")[0], F.col("_v"))).groupBy(*keys, "_v").agg(F.count("*").alias("_k"), F.max("_n").alias("_n"))
    ranked = counted.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v"))))
    # the least values that at least half the group, and over half of it, reach
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    low, high = (F.min(F.when(F.col("_upto") >= at, F.col("_v"))) for at in (lower, upper))
    return ranked.groupBy(*keys).agg(((low + high) / 2).alias("median"))
