"""Queries that write tables with the sinks and read them back with the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.operators import multiverse as mv
from chronomesh.operators import static
from chronomesh.plans import fixtures as fx
from chronomesh.plans.fixtures import corr_sql, pairs_sql, r6, with_
from chronomesh.plans.q_multiverse import DECISIONS, NAMES, outcomes, run_sql, space_sql
from chronomesh.plans.registry import query, rounded
from chronomesh.sources import readers, writers
from chronomesh.sources.shared import fresh_path


def _text_lines(s, d, separator: str, header: bool):
    """The hourly panel as lines of a delimited file, one file as the readers take it."""
    wide = fx.hourly(s, d).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("roi", F.round("x", 6).cast("string").alias("x")))).alias("v"))
    lines = wide.select("t", F.array_join(F.transform("v", lambda c: c["x"]), separator).alias("value"))
    if header:
        names = wide.limit(1).select(F.lit(-1).cast("long").alias("t"), F.array_join(F.transform("v", lambda c: c["roi"]), separator).alias("value"))
        lines = names.union(lines)
    return lines.orderBy("t").select("value").coalesce(1)


def _delimited(s, d, separator: str, header: bool, read):
    path = fresh_path(s, "panel")
    _text_lines(s, d, separator, header).write.text(path)
    return read(path)


_HOURLY = with_("hourly", body=f"select subject, t, roi, {r6('x')} x from hourly")
query("io_tsv", _HOURLY)(lambda s, d: rounded(_delimited(s, d, "\t", True, lambda p: readers.read_tsv(s, p)), "x"))
query("io_confounds", with_("hourly", body=f"select subject, t, roi as name, {r6('x')} x from hourly where roi in ('click', 'error')"))(lambda s, d: rounded(_delimited(s, d, ";", True, lambda p: readers.read_confounds(s, p, ["click", "error", "not there"])), "x"))
query("io_matrix_text", with_("hourly", k="select roi, row_number() over (order by roi) - 1 k from (select distinct roi from hourly)", body=f"select subject, t, k roi, {r6('x')} x from hourly join k using (roi)"))(
    lambda s, d: rounded(_delimited(s, d, " ", False, lambda p: readers.read_matrix_text(s, p)), "x")
)


def _panel(s, d):
    path = fresh_path(s, "panel")
    writers.write_panel(fx.subjects(s, d), path)
    return s.read.parquet(path).select(F.col("subject").cast("long").alias("subject"), "t", "roi", "x")


def _edges(s, d):
    path = fresh_path(s, "edges")
    writers.write_edges(static.pearson(fx.subjects(s, d)), path)
    return s.read.parquet(path).select(F.col("subject").cast("long").alias("subject"), "i", "j", "w")


query("io_panel", with_("subj", body=f"select subject, t, roi, {r6('x')} x from subj"))(lambda s, d: rounded(_panel(s, d), "x"))
_SUMS = "count(*) n, sum(x) sx, sum(y) sy, sum(x * y) sxy, sum(x * x) sxx, sum(y * y) syy"
query("io_edges", with_("subj", p=pairs_sql("subj"), q=f"select subject, i, j, {_SUMS} from p group by all", body=f"select subject, i, j, {r6(corr_sql())} w from q"))(lambda s, d: rounded(_edges(s, d), "w"))


def _multiverse(s, d):
    """The space as a CSV summary and each half of the results appended, loaded again."""
    summary, results = fresh_path(s, "summary"), fresh_path(s, "results")
    writers.write_summary(mv.create(s, DECISIONS), summary)
    found = outcomes(s, d).select("universe", F.lit("outcome").alias("measure"), F.col("outcome").alias("value"))
    for half in (0, 1):
        writers.save_universe_results(found.filter(F.col("universe") % 2 == half), results)
    space, loaded = writers.load_multiverse(s, summary, results)
    return loaded.join(space.drop("order_id"), "universe").select("universe", *NAMES, "measure", "value")


query("io_multiverse", run_sql(f"select universe, {', '.join(NAMES)}, 'outcome' measure, outcome as value from res"))(_multiverse)


def _summary(s, d):
    path = fresh_path(s, "summary")
    writers.write_summary(mv.create(s, DECISIONS), path)
    return writers.read_summary(s, path).select("universe", *NAMES)


query("io_summary", space_sql(f"select universe, {', '.join(NAMES)} from sp"))(_summary)
query("io_json", "select event_type, cast(json_extract_string(props, '$.k') as bigint) k, count(*) n, round(sum(value), 4) + 0.0 total from events group by all")(
    lambda s, d: readers.read_props(fx.read(s, d, "events"), "props", "k long").groupBy("event_type", "k").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("total"))
)


def _scans(s, d):
    name = F.concat(F.lit("/data/sub-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("_task-"), F.col("c_mktsegment"), F.lit("_run-"), (F.col("c_nationkey") % 3).cast("string"), F.lit("_bold.nii.gz"))
    return readers.list_scans(fx.read(s, d, "customer").select(name.alias("path")), task="BUILDING").drop("path")


query("io_scans", "select lpad(cast(c_custkey as varchar), 5, '0') subject, c_mktsegment task, cast(c_nationkey % 3 as varchar) run, 'bold' suffix from customer where c_mktsegment = 'BUILDING'")(_scans)
