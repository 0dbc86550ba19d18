"""Adapters that give panels, graphs and state sequences over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.operators.graph_prep import Graph
from chronomesh.operators.panel import scaffold

DAYS, HOURS, MONTHS, DIMS = 30, 720, 83, 64


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _day():
    return F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums of events by type, subject 0."""
    return read(spark, d, "events").groupBy(F.lit(0).cast("long").alias("subject"), _day().alias("t"), F.col("event_type").alias("roi")).agg(F.sum("value").alias("x"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    hour = (_day() * 24 + F.hour("ts")).cast("long")
    return scaffold(read(spark, d, "events").groupBy(F.lit(0).cast("long").alias("subject"), hour.alias("t"), F.col("event_type").alias("roi")).agg(F.sum("value").alias("x")), HOURS)


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums of events by type for eight groups of users."""
    return scaffold(read(spark, d, "events").groupBy((F.col("user_id") % 8).alias("subject"), _day().alias("t"), F.col("event_type").alias("roi")).agg(F.sum("value").alias("x")), DAYS)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Monthly revenue by the supplier's nation."""
    date = F.col("l_shipdate").cast("date")
    t = ((F.year(date) - 1995) * 12 + F.month(date) - 1).cast("long")
    joined = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    revenue = joined.groupBy(F.lit(0).cast("long").alias("subject"), t.alias("t"), F.col("s_nationkey").alias("roi")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return scaffold(revenue, MONTHS)


def embed(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as series: subject is the label, time the place among its vectors, regions its dimensions."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("subject"), (place - 1).cast("long").alias("t"), F.col("embedding").alias("e"))
    return rows.select("subject", "t", F.posexplode("e").alias("roi", "x")).select("subject", "t", F.col("roi").cast("long").alias("roi"), F.col("x").cast("double").alias("x"))


def trade(spark: SparkSession, d: str) -> Graph:
    """Nations linked by the number of line items between customer and supplier."""
    a, b = F.col("c_nationkey").cast("long"), F.col("s_nationkey").cast("long")
    joined = (
        read(spark, d, "lineitem")
        .join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    edges = joined.filter(a != b).groupBy(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.count("*").cast("double").alias("w"))
    edges = edges.select(F.lit(0).cast("long").alias("subject"), F.lit(0).cast("long").alias("t"), "i", "j", "w")
    return Graph(edges, read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i")))


def signed(spark: SparkSession, d: str) -> Graph:
    """Correlations of the monthly panel's nations as a signed graph."""
    from chronomesh.operators.static import pearson

    edges = pearson(monthly(spark, d)).select("subject", F.lit(0).cast("long").alias("t"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.coalesce(F.round("w", 6), F.lit(0.0)).alias("w"))
    return Graph(edges, read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i")))


def regions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("module"))


def states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sequence of event types as states 0.."""
    e = read(spark, d, "events")
    kinds = e.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("state"))
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.join(F.broadcast(kinds), "event_type").select(F.col("user_id").cast("long").alias("subject"), t.cast("long").alias("t"), "state")


DAY_SQL = "date_diff('day', date '2024-01-01', cast(ts as date))"

#: Common table expressions of the same names.
SQL = {
    "daily": f"select cast(0 as bigint) subject, {DAY_SQL} t, event_type roi, sum(value) x from events group by all",
    "hourly": f"""select cast(0 as bigint) subject, g.t, r.roi, coalesce(b.x, 0.0) x from (select unnest(range({HOURS})) t) g cross join (select distinct event_type roi from events) r
        left join (select {DAY_SQL} * 24 + hour(ts) t, event_type roi, sum(value) x from events group by all) b on b.t = g.t and b.roi = r.roi""",
    "subj": f"""select s.subject, g.t, r.roi, coalesce(b.x, 0.0) x from (select distinct user_id % 8 subject from events) s cross join (select unnest(range({DAYS})) t) g
        cross join (select distinct event_type roi from events) r
        left join (select user_id % 8 subject, {DAY_SQL} t, event_type roi, sum(value) x from events group by all) b on b.t = g.t and b.roi = r.roi and b.subject = s.subject""",
    "monthly": f"""select cast(0 as bigint) subject, g.t, r.roi, coalesce(b.x, 0.0) x from (select unnest(range({MONTHS})) t) g
        cross join (select distinct s_nationkey roi from supplier join lineitem on l_suppkey = s_suppkey) r
        left join (select (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 t, s_nationkey roi, sum(l_extendedprice * (1 - l_discount)) x
            from lineitem join supplier on l_suppkey = s_suppkey group by all) b on b.t = g.t and b.roi = r.roi""",
    "embed": f"""select subject, t, cast(k as bigint) roi, cast(embedding[k + 1] as double) x from (select cast(label as bigint) subject, row_number() over (partition by label order by vec_id) - 1 t, embedding from embeddings)
        cross join (select unnest(range({DIMS})) k)""",
    "nodes": "select cast(n_nationkey as bigint) i from nation",
    "regions": "select cast(n_nationkey as bigint) i, cast(n_regionkey as bigint) module from nation",
    "trade": """select cast(least(c_nationkey, s_nationkey) as bigint) i, cast(greatest(c_nationkey, s_nationkey) as bigint) j, cast(count(*) as double) w
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by all""",
    "states": """select cast(user_id as bigint) subject, row_number() over (partition by user_id order by ts, event_id) - 1 t, cast(s.state as integer) state
        from events join (select event_type, row_number() over (order by event_type) - 1 state from (select distinct event_type from events)) s using (event_type)""",
}


def pairs_sql(source: str, diagonal: bool = False) -> str:
    return f"select a.subject, a.t, a.roi i, b.roi j, a.x, b.x y from {source} a join {source} b on a.subject = b.subject and a.t = b.t and a.roi {'<=' if diagonal else '<'} b.roi"


def corr_sql(n: str = "n", sx: str = "sx", sy: str = "sy", sxy: str = "sxy", sxx: str = "sxx", syy: str = "syy") -> str:
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    return f"case when {vx} > 1e-12 * {n} * {sxx} and {vy} > 1e-12 * {n} * {syy} then greatest(-1.0, least(1.0, ({n} * {sxy} - {sx} * {sy}) / sqrt({vx} * {vy}))) end"


def with_(*names: str, body: str, recursive: bool = False, once: bool = False, **more: str) -> str:
    """body under the named fixtures and further expressions in order. once: each expression is evaluated once."""
    held = "as materialized" if once else "as"
    parts = [f"{n} {held} ({SQL[n]})" for n in names] + [f"{n} {held} ({q})" for n, q in more.items()]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
