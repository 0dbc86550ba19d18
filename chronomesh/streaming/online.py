"""Online connectivity and dwell over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronomesh.functions.stats import corr_from_sums
from chronomesh.sources.shared import fresh_path


def bucketed(events: DataFrame, bucket: str = "1 hour", watermark: str = "1 day", ts: str = "ts", roi: str = "event_type", value: str = "value") -> DataFrame:
    """(bucket, roi, x): sums by time bucket and region; late events beyond the watermark are dropped by Spark."""
    typed = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(roi).alias("roi"), F.col(value).cast("double").alias("x"))
    return typed.withWatermark("ts", watermark).groupBy(F.window("ts", bucket).alias("bucket"), "roi").agg(F.sum("x").alias("x"))


def window_correlation(rows: DataFrame, length: str, slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """(window_start, i, j, n, w) from wide rows (ts, v map<roi, x>): correlations over sliding event-time windows.

    Pairs are made within the row and only mergeable power sums are state, so a window's state is a few numbers per
    pair however many rows it holds. Works on streams and tables alike.
    """
    made = "flatten(transform(map_entries(v), a -> transform(filter(map_entries(v), b -> b.key > a.key), b -> struct(a.key as i, b.key as j, a.value as x, b.value as y))))"
    pairs = rows.withWatermark("ts", watermark).select("ts", F.expr(f"inline({made})"))
    x, y = F.col("x"), F.col("y")
    sums = pairs.groupBy(F.window("ts", length, slide or length).alias("win"), "i", "j").agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy")
    )
    return sums.select(F.col("win.start").alias("window_start"), "i", "j", F.col("n").cast("long").alias("n"), corr_from_sums(*(F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))).alias("w"))


def sessions(events: DataFrame, gap: str = "6 hours", watermark: str = "1 day", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, start, end, n): sessions of events that are at most `gap` apart."""
    typed = events.select(F.col(user).alias("user"), F.col(ts).cast("timestamp").alias("ts"))
    made = typed.withWatermark("ts", watermark).groupBy("user", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return made.select("user", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


RUNS = "user long, state string, first_ts timestamp, length long"


def online_runs(events: DataFrame, user: str = "user_id", ts: str = "ts", state: str = "event_type", timeout: str = "7 days", watermark: str = "1 day") -> DataFrame:
    """(user, state, first_ts, length): completed stretches of one state, as they end.

    A user's state is the open stretch. Within a micro-batch events are put in order of time; an event older than the
    open stretch's last one is taken as it comes. A stretch also ends when nothing follows for the timeout.
    """
    hold = pd.Timedelta(timeout)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if held.hasTimedOut:
            name, first, n = held.get
            held.remove()
            out.append((key[0], name, pd.Timestamp(first), n))
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            name, first, n = held.get if held.exists else (None, None, 0)
            for r in rows.itertuples(index=False):
                if r.state == name:
                    n += 1
                    continue
                if name is not None:
                    out.append((key[0], name, pd.Timestamp(first), n))
                name, first, n = r.state, r.ts.isoformat(), 1
            held.update((name, first, n))
            held.setTimeoutTimestamp(int((rows["ts"].max() + hold).timestamp() * 1000))
        yield pd.DataFrame(out, columns=["user", "state", "first_ts", "length"])

    typed = events.select(F.col(user).cast("long").alias("user"), F.col(ts).cast("timestamp").alias("ts"), F.col(state).cast("string").alias("state"))
    return typed.withWatermark("ts", watermark).groupBy("user").applyInPandasWithState(step, RUNS, "state string, first string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that a stream's source holds now into Parquet in the shared folder, and return that table.

    append: each micro-batch adds its rows under its own number, so one that is run again replaces what it wrote.
    complete: the last micro-batch's rows are the result.
    """
    spark, schema = stream.sparkSession, stream.schema
    path = fresh_path(spark, "stream")
    last: list[int] = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{batch:08d}")
        last.append(batch)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows/{max(last):08d}" if mode == "complete" else f"{path}/rows/*")
