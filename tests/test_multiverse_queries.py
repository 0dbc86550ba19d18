"""Queries over the order multiverse give their SQL's rows on tables that the drawn ones don't hold."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronomesh.functions.stats import exact_medians
from chronomesh.plans import fixtures as fx
from tests.test_oracle import SF, plain, pytestmark  # noqa: F401


def same(spark, name, d):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    df, sql = entry.queries()[name](spark, d), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [sql.columns.index(c) for c in columns]
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()), sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def tables(folder, **sql):
    """The drawn tables, or what these queries make of them."""
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for t in ("orders", "customer", "lineitem"):
        con.sql(f"copy ({sql.get(t, f'select * from {t}')}) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["mv_orders_run", "mv_get_results", "mv_speccurve", "mv_specpanel", "mv_effects", "mv_compare"])
def test_line_sums_of_another_last_bit(spark, monkeypatch, name):
    """Whenever line items are summed anew, as after a shuffle, the last bits may differ; the three dropped orders must not."""
    read = fx.read
    shaken = F.udf(lambda x: x * (1 + (os.urandom(1)[0] % 3 - 1) * 2.0**-50), "double").asNondeterministic()
    monkeypatch.setattr(fx, "read", lambda s, d, t: read(s, d, t).withColumn("l_extendedprice", shaken("l_extendedprice")) if t == "lineitem" else read(s, d, t))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # each pass sums for itself, as executors do that fetch in another order
    try:
        got, expect = same(spark, name, SF)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == expect


def test_repeated_orders_are_dropped_one_by_one(spark, tmp_path):
    d = tables(tmp_path, orders="select * from orders union all from orders")
    got, expect = same(spark, "mv_orders_run", d)
    assert got == expect


def test_medians_of_one_pass_and_its_brackets(spark, monkeypatch):
    """Brackets depend on the order in which executors' summaries are merged: what is counted below must be so by the same bracket."""
    approximate = F.percentile_approx
    moved = F.udf(lambda x: x + os.urandom(1)[0] / 4, "double")
    monkeypatch.setattr(F, "percentile_approx", lambda x, *more: approximate(moved(x), *more))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
        got = {r.k: r.median for r in exact_medians(rows, ["k"], "x", 0.2).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {0: 499.0, 1: 500.0}


@pytest.mark.parametrize("name", ["mv_speccurve", "mv_specpanel"])
def test_universes_without_outcome_rank_last(spark, tmp_path, name):
    got, expect = same(spark, name, tables(tmp_path, orders="select * from orders where o_orderstatus <> 'P'"))
    assert got == expect


def test_comparison_with_universes_without_outcome(spark, tmp_path):
    """uniform and bma; the SQL's closed forms of the other weights hold only where every universe has an outcome."""
    got, expect = same(spark, "mv_compare", tables(tmp_path, orders="select * from orders where o_orderstatus <> 'P'"))
    methods = [[r for r in rows if r[-1] in ("uniform", "bma")] for rows in (got, expect)]
    assert len(methods[0]) == 2 and methods[0] == methods[1]
