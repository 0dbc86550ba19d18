"""Queries that run the streaming operators over the events table, as a stream of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.plans.fixtures import corr_sql, r6
from chronomesh.plans.registry import query, rounded
from chronomesh.streaming import online


def _events(s, d):
    table = s.read.parquet(f"{d}/events.parquet")
    return s.readStream.schema(table.schema).option("pathGlobFilter", "events*.parquet").parquet(d)


def _window_corr(s, d):
    """Daily windows of the events' value against their hour and second, as a stream of power sums."""
    rows = _events(s, d).select(F.col("ts").cast("timestamp").alias("ts"), F.create_map(F.lit("hour"), F.hour("ts").cast("double"), F.lit("user"), F.col("user_id").cast("double"), F.lit("value"), F.col("value")).alias("v"))
    out = online.run_available(online.window_correlation(rows, "1 day"), "complete")
    return rounded(out.select(F.datediff(F.col("window_start").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"), "i", "j", "n", "w"), "w")


_ROWS = "select date_diff('day', date '2024-01-01', cast(ts as date)) t, cast(hour(ts) as double) h, cast(user_id as double) u, value v from events"
_PAIR = "select t, '{i}' i, '{j}' j, count(*) n, sum({a}) sx, sum({b}) sy, sum({a} * {b}) sxy, sum({a} * {a}) sxx, sum({b} * {b}) syy from e group by t"
_ALL = " union all ".join(_PAIR.format(i=i, j=j, a=a, b=b) for i, j, a, b in (("hour", "user", "h", "u"), ("hour", "value", "h", "v"), ("user", "value", "u", "v")))
query("stream_window_corr", f"with e as ({_ROWS}), s as ({_ALL}) select t, i, j, n, {r6(corr_sql())} w from s")(_window_corr)


def _sessions(s, d):
    return online.run_available(online.sessions(_events(s, d)), "complete").select("user", "n")


_SESSIONS = """with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) p from events),
    g as (select user_id, sum(case when p is null or ts - p > interval 6 hours then 1 else 0 end) over (partition by user_id order by ts) k from l)
    select user_id as user, count(*) n from g group by user_id, k"""
query("stream_sessions", _SESSIONS)(_sessions)
# a user's last stretch is still open unless the watermark, a day behind the last event of all, has passed its end by seven days
_STREAM_RUNS = """with n as (select *, case when lag(event_type) over w = event_type then 0 else 1 end new from events window w as (partition by user_id order by ts)),
    r as (select *, sum(new) over (partition by user_id order by ts) run from n),
    g as (select user_id, run, any_value(event_type) state, count(*) length, max(ts) last_ts from r group by user_id, run),
    h as (select *, max(run) over (partition by user_id) last_run, max(last_ts) over () last_all from g)
    select cast(user_id as bigint) as user, state, length from h where run < last_run or last_ts + interval 7 days <= last_all - interval 1 day"""
query("stream_runs", _STREAM_RUNS)(lambda s, d: online.run_available(online.online_runs(_events(s, d))).select("user", "state", "length"))
