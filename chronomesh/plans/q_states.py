"""Queries over state sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.operators import dynamic, states
from chronomesh.plans import fixtures as fx
from chronomesh.plans.fixtures import r6, with_
from chronomesh.plans.registry import query, rounded

_CELLS = "select subject, s state from (select distinct subject from states) cross join (select unnest(range(5)) s)"
_RUNS = {
    "n": "select *, case when lag(state) over w = state then 0 else 1 end new from states window w as (partition by subject order by t)",
    "r": "select *, sum(new) over (partition by subject order by t) run from n",
    "g": "select subject, run, any_value(state) state, min(t) first_t, count(*) length from r group by subject, run",
}
_TRANS = {
    "l": "select subject, state a, lead(state) over (partition by subject order by t) b from states",
    "c": "select subject, a, b, count(*) n from l where b is not null group by all",
    "z": "select subject, x a, y b from (select distinct subject from states) cross join (select unnest(range(5)) x) cross join (select unnest(range(5)) y)",
    "f": "select z.subject, z.a, z.b, coalesce(n, 0) n from z left join c using (subject, a, b)",
}

query("occupancy", with_("states", c=_CELLS, o="select subject, state, count(*) / sum(count(*)) over (partition by subject) o from states group by subject, state", body=f"select c.subject, cast(c.state as integer) state, {r6('coalesce(o, 0.0)')} occupancy from c left join o using (subject, state)"))(
    lambda s, d: rounded(states.fractional_occupancy(fx.states(s, d)), "occupancy")
)
query("state_runs", with_("states", **_RUNS, body="select subject, cast(run as bigint) run, state, first_t, length from g"))(lambda s, d: states.runs(fx.states(s, d)).withColumn("run", F.col("run").cast("long")))
query("dwell", with_("states", **_RUNS, c=_CELLS, m="select subject, state, avg(length) dwell from g group by all", body=f"select c.subject, cast(c.state as integer) state, {r6('coalesce(dwell, 0.0)')} dwell from c left join m using (subject, state)"))(
    lambda s, d: rounded(states.dwell_times(fx.states(s, d)), "dwell")
)
query("trans_counts", with_("states", **_TRANS, body="select subject, cast(a as integer) s_from, cast(b as integer) s_to, n from f"))(lambda s, d: states.transition_counts(fx.states(s, d)))
query("trans_matrix", with_("states", **_TRANS, body=f"select subject, cast(a as integer) s_from, cast(b as integer) s_to, {r6('case when sum(n) over w = 0 then 0.0 else n / sum(n) over w end')} p from f window w as (partition by subject, a)"))(
    lambda s, d: rounded(states.transition_matrix(fx.states(s, d)), "p")
)
_SWITCH = with_("states", l="select subject, t, case when lag(state) over (partition by subject order by t) <> state then 1 else 0 end c from states", body=f"select subject, cast(sum(c) as bigint) switches, {r6('sum(c) / greatest(count(*) - 1, 1)')} switch_rate from l group by subject")
query("switches", _SWITCH)(lambda s, d: rounded(states.switches(fx.states(s, d)), "switch_rate"))
query("state_group_mean", with_("states", c=_CELLS, o="select subject, state, count(*) / sum(count(*)) over (partition by subject) o from states group by subject, state", v="select c.subject, c.state, coalesce(o, 0.0) o from c left join o using (subject, state)", body=f"select cast(state as integer) state, {r6('avg(o)')} mean, {r6('stddev_pop(o)')} std from v group by state"))(
    lambda s, d: rounded(states.group_means(states.fractional_occupancy(fx.states(s, d)), ["state"], "occupancy"), "mean", "std")
)


def _centroids(s, d):
    """Mean embedding of each label as fixed centroids."""
    rows = fx.embed(s, d).groupBy("subject", "roi").agg(F.round(F.avg("x"), 6).alias("x"))
    return rows.groupBy(F.col("subject").cast("int").alias("state")).agg(F.transform(F.array_sort(F.collect_list(F.struct("roi", "x"))), lambda v: v["x"]).alias("c"))


_NEAR = {
    "c": "select cast(subject as integer) state, roi, round(avg(x), 6) x from embed group by all",
    "q": "select e.subject, e.t, c.state, sum((e.x - c.x) * (e.x - c.x)) dd from embed e join c using (roi) group by all",
    "b": "select subject, t, arg_min(state, dd) state, sqrt(min(dd)) distance from q group by all",
}
query("assign_centroid", with_("embed", **_NEAR, body=f"select subject, t, state, {r6('distance')} distance from b"))(lambda s, d: rounded(states.assign(states.panel_features(fx.embed(s, d)), _centroids(s, d)), "distance"))
query("inertia", with_("embed", **_NEAR, body=f"select {r6('sum(distance * distance)')} inertia from b"))(lambda s, d: rounded(states.inertia(states.panel_features(fx.embed(s, d)), _centroids(s, d)), "inertia"))
query("state_outer", with_("embed", c=_NEAR["c"], body=f"select a.state, cast(a.roi as integer) i, cast(b.roi as integer) j, {r6('a.x * b.x')} w from c a join c b on a.state = b.state and a.roi <= b.roi"))(
    lambda s, d: rounded(states.outer_states(_centroids(s, d)), "w")
)


def _small(s, d):
    return fx.subjects(s, d)


query("kmeans_pooled")(lambda s, d: states.kmeans_cluster(dynamic.sliding_window(_small(s, d), 7, 3), 3, n_init=2)["state_tc"])
query("kmeans_two_level")(lambda s, d: states.kmeans_cluster(dynamic.sliding_window(_small(s, d), 7, 3), 3, "two_level", 3, n_init=10)["state_tc"])
query("swc")(lambda s, d: states.sliding_window_clustering(_small(s, d), 3, 3, 9, 3, n_init=10)[0])
query("cap")(lambda s, d: states.coactivation_patterns(_small(s, d), 3, 3, n_init=10)[0])
query("ksvd")(lambda s, d: rounded(states.ksvd_states(_small(s, d), 3)[0], "weight", digits=4))
query("ksvd_atoms")(lambda s, d: rounded(states.ksvd_states(_small(s, d), 3)[1].select("state", F.posexplode("c").alias("place", "c")), "c", digits=4))


def _atoms(s, d):
    """The labels' mean embeddings, scaled to unit length, as a fixed dictionary."""
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return _centroids(s, d).select("state", F.transform("c", lambda x: F.round(x / norm, 6)).alias("c"))


query("ksvd_encode", with_("embed", c=_NEAR["c"], a="select state, roi, round(x / sqrt(sum(x * x) over (partition by state)), 6) x from c", q="select e.subject, e.t, a.state, sum(e.x * a.x) v from embed e join a using (roi) group by all",
    body=f"select subject, t, arg_max(state, abs(v)) state, {r6('arg_max(v, abs(v))')} weight from q group by subject, t"))(lambda s, d: rounded(states.encode_atoms(states.panel_features(fx.embed(s, d)), _atoms(s, d)), "weight"))
query("ghmm")(lambda s, d: rounded(states.gaussian_hmm_states(_small(s, d), 3, 4), "score", digits=3))
query("ghmm_covariances")(lambda s, d: rounded(states.gaussian_hmm_matrices(_small(s, d), 3, 4), "w", digits=2))
query("dhmm")(lambda s, d: states.discrete_hmm_states(_small(s, d), 3, 1.0, 3, 9, 3, restarts=4, n_init=5)[0])
