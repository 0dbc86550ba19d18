"""Queries over graphs: preparation, measures, paths, partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.operators import graph_measures as gm
from chronomesh.operators import graph_paths as gp
from chronomesh.operators import graph_prep as prep
from chronomesh.operators.graph_prep import Graph
from chronomesh.plans import fixtures as fx
from chronomesh.plans.fixtures import corr_sql, pairs_sql, r6, with_
from chronomesh.plans.registry import query, rounded

_SUMS = "count(*) n, sum(x) sx, sum(y) sy, sum(x * y) sxy, sum(x * x) sxx, sum(y * y) syy"
_SIGNED = {"p": pairs_sql("monthly"), "s": f"select i, j, {_SUMS} from p group by all", "sg": f"select cast(i as bigint) i, cast(j as bigint) j, coalesce(round({corr_sql()}, 6), 0.0) w from s"}


def signed_sql(body: str) -> str:
    return with_("monthly", **_SIGNED, body=body)


def _prep(name: str, sql: str, make, digits: int = 6):
    query(name, sql)(lambda s, d: rounded(make(s, d).select("i", "j", "w"), "w", digits=digits))


_prep("neg_abs", signed_sql(f"select i, j, {r6('abs(w)')} w from sg"), lambda s, d: prep.handle_negative_weights(fx.signed(s, d)))
_prep("neg_discard", signed_sql(f"select i, j, {r6('greatest(w, 0.0)')} w from sg"), lambda s, d: prep.handle_negative_weights(fx.signed(s, d), "discard"))
_prep("thr_absolute", signed_sql(f"select i, j, {r6('w')} w from sg where w >= 0.1"), lambda s, d: prep.threshold(fx.signed(s, d), "absolute", 0.1))


def top_sql(density: float, source: str = "trade") -> str:
    return f"""select i, j, w from (select *, row_number() over (order by w desc, i desc, j desc) k from {source}) where k <= floor((select count(*) * (count(*) - 1) / 2 from nodes) * {density} + 0.5)"""


_prep("thr_density", with_("trade", "nodes", body=top_sql(0.2)), lambda s, d: prep.threshold(fx.trade(s, d), density=0.2))
_prep("binarise", with_("trade", "nodes", e=top_sql(0.2), body="select i, j, 1.0::double w from e"), lambda s, d: _top(s, d, 0.2, prep.binarise).edges)
_prep("normalise", with_("trade", body=f"select i, j, {r6('w / max(abs(w)) over ()')} w from trade"), lambda s, d: prep.normalise(fx.trade(s, d)))
_prep("minmax", with_("trade", "nodes", a="select a.i, b.i j, coalesce(w, 0.0) w from nodes a join nodes b on a.i < b.i left join trade t on t.i = a.i and t.j = b.i", body=f"select i, j, {r6('-1 + (w - min(w) over ()) / (max(w) over () - min(w) over ()) * 2')} w from a"), lambda s, d: prep.minmax_scale(fx.trade(s, d), -1.0, 1.0))
_prep("invert", with_("trade", body="select i, j, round(1 / w, 9) + 0.0 w from trade"), lambda s, d: prep.invert(fx.trade(s, d)), 9)
_prep("logtransform", with_("trade", body=f"select i, j, {r6('-ln(w / (select max(w) from trade))')} w from trade"), lambda s, d: prep.log_transform(fx.trade(s, d).pipe(prep.normalise)))
_prep("g_postproc", signed_sql("select i, j, round(w / 3, 6) + 0.0 w from sg"), lambda s, d: prep.postprocess(Graph(fx.signed(s, d).with_w(F.col("w") / 3), fx.trade(s, d).nodes)))


def _directed(s, d):
    return fx.trade(s, d).edges.select("i", "j", "w").union(fx.trade(s, d).edges.filter("(i + j) % 3 = 0").selectExpr("j", "i", "w * 2"))


_DIRECTED = "select i, j, w from trade union all select j, i, w * 2 from trade where (i + j) % 3 = 0"
query("symmetrise", with_("trade", e=_DIRECTED, body=f"select least(i, j) i, greatest(i, j) j, {r6('sum(w) / 2')} w from e group by 1, 2"))(lambda s, d: rounded(prep.symmetrise(_directed(s, d), []), "w"))
query("symmetrise_binary", with_("trade", e=_DIRECTED, body="select distinct least(i, j) i, greatest(i, j) j, 1.0::double w from e"))(lambda s, d: prep.symmetrise(_directed(s, d), [], True))


def _top(s, d, density: float, op=None) -> Graph:
    g = fx.trade(s, d).pipe(prep.threshold_density, density)
    return g.pipe(op) if op else g


# common SQL: the densest tenth or fifth of the trade graph, both directions, weights over the largest
_T = {
    "e": top_sql(0.2),
    "u": "select i, j, w / max(w) over () w from e",
    "b": "select i, j, w from u union all select j, i, w from u",
    "k": "select i, count(*) k from b group by i",
    "tri": "select unnest([x.i, x.j, y.j]) i, x.w * y.w * z.w w3 from u x join u y on x.j = y.i join u z on z.i = x.i and z.j = y.j",
    "cy": "select i, 2.0 * count(*) c, 2.0 * sum(cbrt(w3)) cw from tri group by i",
    "nk": "select n.i, coalesce(k, 0) k, coalesce(c, 0.0) c, coalesce(cw, 0.0) cw from nodes n left join k using (i) left join cy using (i)",
}


def t_sql(body: str, **more: str) -> str:
    return with_("trade", "nodes", "regions", **_T, **more, body=body)


def _w(s, d) -> Graph:
    return _top(s, d, 0.2, prep.normalise)


def _b(s, d) -> Graph:
    return _top(s, d, 0.2, prep.binarise)


query("degree", t_sql("select i, k degree from nk"))(lambda s, d: gm.degrees(_w(s, d)).select("i", "degree"))
query("density", t_sql(f"select {r6('count(*) * 2.0 / ((select count(*) from nodes) * ((select count(*) from nodes) - 1))')} density, (select count(*) from nodes) n, count(*) k from u"))(lambda s, d: rounded(gm.density(_w(s, d)).select("density", "n", "k"), "density"))
query("clustering_bin", t_sql(f"select i, {r6('case when k > 1 then c / (k * (k - 1)) else 0.0 end')} clustering from nk"))(lambda s, d: rounded(gm.clustering(_b(s, d)).select("i", "clustering"), "clustering"))
query("clustering_wei", t_sql(f"select i, {r6('case when k > 1 then cw / (k * (k - 1)) else 0.0 end')} clustering from nk"))(lambda s, d: rounded(gm.clustering(_w(s, d), True).select("i", "clustering"), "clustering"))
query("onnela", t_sql(f"select {r6('avg(case when k > 1 then cw / (k * (k - 1)) else 0.0 end)')} clustering from nk"))(lambda s, d: rounded(gm.onnela(_w(s, d)).select("clustering"), "clustering"))
query("transitivity_bin", t_sql(f"select {r6('sum(c) / sum(k * (k - 1))')} transitivity from nk"))(lambda s, d: rounded(gm.transitivity(_b(s, d)).select("transitivity"), "transitivity"))
query("transitivity_wei", t_sql(f"select {r6('sum(cw) / sum(k * (k - 1))')} transitivity from nk"))(lambda s, d: rounded(gm.transitivity(_w(s, d), True).select("transitivity"), "transitivity"))
query("matching", t_sql(f"select cm.i, cm.j, {r6('2.0 * n / case when dg <= 2 and n <> 1 then 1.0 else dg end')} matching from m cm",
    cmn="select x.j i, y.j j, count(*) n from b x join b y on x.i = y.i and x.j < y.j group by all",
    m="select cmn.i, cmn.j, n, ka.k + kb.k - 2 * (case when u.i is null then 0 else 1 end) dg from cmn join k ka on ka.i = cmn.i join k kb on kb.i = cmn.j left join u on u.i = cmn.i and u.j = cmn.j"))(
    lambda s, d: rounded(gm.matching_index(_w(s, d)).select("i", "j", "matching"), "matching")
)
query("participation", t_sql(f"select n.i, {r6('coalesce(p, 0.0)')} participation from nodes n left join pt using (i)",
    st="select b.i, module, sum(w) s from b join regions r on r.i = b.j group by all", sh="select i, s / sum(s) over (partition by i) q from st", pt="select i, 1 - sum(q * q) p from sh group by i"))(
    lambda s, d: rounded(gm.participation(_w(s, d), fx.regions(s, d)).select("i", "participation"), "participation")
)


def _part(sign: str) -> str:
    return f"select i, 1 - sum(q * q) p from (select i, s / sum(s) over (partition by i) q from (select x.i, module, sum(greatest({sign}w, 0.0)) s from bb x join regions r on r.i = x.j where {sign}w > 0 group by all)) group by i"


query("participation_sign", with_("monthly", "nodes", "regions", **_SIGNED, bb="select i, j, w from sg union all select j, i, w from sg", po=_part(""), ne=_part("-"),
    body=f"select n.i, {r6('coalesce(po.p, 0.0)')} positive, {r6('coalesce(ne.p, 0.0)')} negative from nodes n left join po on po.i = n.i left join ne on ne.i = n.i"))(
    lambda s, d: rounded(gm.participation_signed(fx.signed(s, d), fx.regions(s, d)).select("i", "positive", "negative"), "positive", "negative")
)
_BFS = {
    "e": top_sql(0.1),
    "b": "select i, j from e union all select j, i from e",
    "wk": "select i s, i v, 0 h from nodes union select wk.s, b.j, wk.h + 1 from wk join b on b.i = wk.v where wk.h < 8",
    "dd": "select s, v, min(h) h from wk group by all",
    "ds": "select a.i i, c.i j, cast(dd.h as double) distance from nodes a join nodes c on a.i < c.i left join dd on dd.s = a.i and dd.v = c.i",
}


def bfs_sql(body: str, **more: str) -> str:
    return with_("trade", "nodes", **_BFS, **more, body=body, recursive=True)


def _b1(s, d) -> Graph:
    return _top(s, d, 0.1, prep.binarise)


def _finite(c: str):
    return F.when(F.abs(c) != float("inf"), F.col(c))


query("bfs_dist", bfs_sql("select i, j, distance from ds"))(lambda s, d: gp.distances(_b1(s, d)).select("i", "j", _finite("distance").alias("distance")))
query("avg_path", bfs_sql(f"select {r6('avg(distance)')} average_path from ds"))(lambda s, d: rounded(gp.average_path(_b1(s, d)).select("average_path"), "average_path"))
query("eff_global", bfs_sql(f"select {r6('sum(coalesce(1 / distance, 0.0)) / count(*)')} efficiency from ds"))(lambda s, d: rounded(gp.efficiency(_b1(s, d)).select("efficiency"), "efficiency"))
_LOCAL = {
    "e": top_sql(0.2),
    "b": "select i, j from e union all select j, i from e",
    "nb": "select x.i u, x.j a, y.j b from b x join b y on x.i = y.i and x.j <> y.j",
    "ed": "select nb.u, nb.a, nb.b from nb join b on b.i = nb.a and b.j = nb.b",
    "wk": "select u, a s, b v, 1 h from ed union select wk.u, wk.s, ed.b, wk.h + 1 from wk join ed on ed.u = wk.u and ed.a = wk.v where wk.h < 8 and ed.b <> wk.s",
    "dd": "select u, s, v, min(h) h from wk group by all",
    "ef": "select nb.u, avg(coalesce(1.0 / h, 0.0)) q from nb left join dd on dd.u = nb.u and dd.s = nb.a and dd.v = nb.b group by nb.u",
}
query("eff_local_bin", with_("trade", "nodes", **_LOCAL, body=f"select n.i, {r6('coalesce(q, 0.0)')} efficiency from nodes n left join ef on ef.u = n.i", recursive=True))(lambda s, d: rounded(gp.efficiency(_b(s, d), True).select("i", "efficiency"), "efficiency"))
_PATHS = {
    "sg": "select s, v, h, cast(1 as double) c from dd where h = 0 union all select sg.s, b.j, sg.h + 1, sg.c from sg join b on b.i = sg.v join dd on dd.s = sg.s and dd.v = b.j and dd.h = sg.h + 1",
    "pn": "select s, v, h, sum(c) c from sg group by all",
    "bt": "select x.v i, sum(x.c * y.c / z.c) q from pn x join pn y on y.s = x.v join pn z on z.s = x.s and z.v = y.v and z.h = x.h + y.h where x.v <> x.s and x.v <> y.v and x.s <> y.v group by x.v",
}
query("betweenness_bin", bfs_sql(f"select n.i, {r6('coalesce(q, 0.0)')} betweenness from nodes n left join bt using (i)", **_PATHS))(lambda s, d: rounded(gp.betweenness_centrality(_b1(s, d)).select("i", "betweenness"), "betweenness"))
_WD = {
    "e": "select i, j, 1000.0 / w w from trade",
    "b": "select i, j, w from e union all select j, i, w from e",
    "dm": "select a.i i, c.i j, case when a.i = c.i then 0.0 else coalesce(b.w, 1e300) end w from nodes a cross join nodes c left join b on b.i = a.i and b.j = c.i",
    **{f"m{k}": f"select x.i, y.j, min(x.w + y.w) w from {'dm' if k == 1 else f'm{k - 1}'} x join {'dm' if k == 1 else f'm{k - 1}'} y on x.j = y.i group by all" for k in (1, 2, 3)},
}
query("distance_wei", with_("trade", "nodes", **_WD, body=f"select i, j, {r6('case when w < 1e299 then w end')} distance from m3 where i < j"))(
    lambda s, d: rounded(gp.distances(Graph(fx.trade(s, d).with_w(1000.0 / F.col("w")), fx.trade(s, d).nodes), True).select("i", "j", _finite("distance").alias("distance")), "distance")
)


def _power(rounds: int, step, start: str) -> dict[str, str]:
    return {"x0": start} | {f"x{k + 1}": step(f"x{k}") for k in range(rounds)}


_FULL = {"u": "select i, j, w / max(w) over () w from trade", "b": "select i, j, w from u union all select j, i, w from u"}
query("eigen_cent", with_("trade", "nodes", **_FULL, **_power(30, lambda x: f"select i, v / sqrt(sum(v * v) over ()) v from (select b.i, sum(w * v) v from b join {x} y on y.i = b.j group by b.i)", "select i, 1.0::double v from nodes"), body=f"select i, {r6('v')} centrality from x30"))(
    lambda s, d: rounded(gp.eigenvector(fx.trade(s, d).pipe(prep.normalise)).select("i", "centrality"), "centrality")
)
query("pagerank", with_("trade", "nodes", **_FULL, dg="select i, sum(w) k from b group by i", **_power(80, lambda x: f"select n.i, 0.15 / (select count(*) from nodes) + 0.85 * coalesce(sum(w / k * v), 0.0) v from nodes n left join b on b.i = n.i left join dg on dg.i = b.j left join {x} y on y.i = b.j group by n.i", "select i, 1.0::double / (select count(*) from nodes) v from nodes"), body=f"select i, {r6('v / sum(v) over ()')} as rank from x80"))(
    lambda s, d: rounded(gp.page_rank(fx.trade(s, d).pipe(prep.normalise)).select("i", "rank"), "rank")
)
_CORE = {"e": top_sql(0.1)} | {
    k: v
    for r in range(12)
    for k, v in {
        f"d{r}": f"select i from (select i from {'e' if not r else f'c{r - 1}'} union all select j from {'e' if not r else f'c{r - 1}'}) group by i having count(*) > 1",
        f"c{r}": f"select i, j, w from {'e' if not r else f'c{r - 1}'} where i in (select i from d{r}) and j in (select i from d{r})",
    }.items()
}
query("two_core", with_("trade", "nodes", **_CORE, body="select i, j, w from c11"))(lambda s, d: gm.two_core(_top(s, d, 0.1)).select("i", "j", "w"))
query("nsp_balance_dynamics", with_("subj", h="select subject, t, sum(case when roi < 'm' then x else -x end) h_bal from subj group by all", m="select *, avg(h_bal) over (partition by subject) m from h",
    v="select *, case when lag(case when h_bal > m then 1 else 0 end) over (partition by subject order by t) <> case when h_bal > m then 1 else 0 end then 1 else 0 end mv from m",
    body=f"""select subject, {r6('sum(case when h_bal > m then h_bal else 0.0 end)')} a_int, {r6('sum(case when h_bal < m then abs(h_bal) else 0.0 end)')} a_seg, {r6('avg(case when h_bal >= m then 1.0 else 0.0 end)')} dwell_int,
    {r6('avg(case when h_bal < m then 1.0 else 0.0 end)')} dwell_seg, {r6('sum(mv) / (count(*) - 1)')} frequency from v group by subject"""))(
    lambda s, d: rounded(gp.balance_dynamics(fx.subjects(s, d).groupBy("subject", "t").agg(F.sum(F.when(F.col("roi") < "m", F.col("x")).otherwise(-F.col("x"))).alias("h_bal"))), "a_int", "a_seg", "dwell_int", "dwell_seg", "frequency")
)
query("nsp_calibrate", with_("subj", h="select subject, t, sum(case when roi < 'm' then x else 0.0 end) a, sum(case when roi > 'm' then x else 0.0 end) b from subj group by all", c="select subject, t, a * 2.0 / avg(a) over () h_int, b * 1.5 / avg(b) over () h_seg from h",
    body=f"select subject, t, {r6('h_int')} h_int, {r6('h_seg')} h_seg, {r6('h_int - h_seg')} h_bal from c"))(
    lambda s, d: rounded(gp.calibrate(fx.subjects(s, d).groupBy("subject", "t").agg(F.sum(F.when(F.col("roi") < "m", F.col("x")).otherwise(0.0)).alias("h_int"), F.sum(F.when(F.col("roi") > "m", F.col("x")).otherwise(0.0)).alias("h_seg")), s.createDataFrame([(2.0, 1.5)], "h_int double, h_seg double")), "h_int", "h_seg", "h_bal")
)


def _closure(first: str, join: str, name: str = "m", rounds: int = 5) -> dict[str, str]:
    """Squarings of a path table: join forms paths of twice the length out of {x} (as x and y)."""
    return {f"{name}{k}": join.replace("{x}", first if k == 1 else f"{name}{k - 1}") for k in range(1, rounds + 1)}


_SHORTER = "select x.i, y.j, min(x.w + y.w) w from {x} x join {x} y on x.j = y.i group by all"
_NEAR = {
    "lo": "select b.i u, b.j a, cbrt(b.w) r from b",
    "dm": "select x.u, x.a i, y.a j, case when x.a = y.a then 0.0 else coalesce(cbrt(1 / b.w), 1e300) end w from lo x join lo y on y.u = x.u left join b on b.i = x.a and b.j = y.a",
    **_closure("dm", "select x.u, x.i, y.j, min(x.w + y.w) w from {x} x join {x} y on y.u = x.u and x.j = y.i group by all"),
    "ef": "select m5.u, sum(case when m5.w < 1e299 then p.r * q.r / m5.w else 0.0 end) / (any_value(k) * (any_value(k) - 1)) q from m5 join lo p on p.u = m5.u and p.a = m5.i join lo q on q.u = m5.u and q.a = m5.j join k on k.i = m5.u where m5.i <> m5.j group by m5.u",
}
query("eff_local_wei", with_("trade", "nodes", **{x: _T[x] for x in ("e", "u", "b", "k")}, **_NEAR, once=True, body=f"select n.i, {r6('coalesce(q, 0.0)')} efficiency from nodes n left join ef on ef.u = n.i"))(
    lambda s, d: rounded(gp.efficiency(_w(s, d), True).select("i", "efficiency"), "efficiency")
)
_WEIGHTED = {
    "e": top_sql(0.2),
    "b": "select i, j, 1.0 / w w from e union all select j, i, 1.0 / w from e",
    "dm": "select a.i i, c.i j, case when a.i = c.i then 0.0 else coalesce(b.w, 1e300) end w from nodes a cross join nodes c left join b on b.i = a.i and b.j = c.i",
    **_closure("dm", _SHORTER),
    "st": "select m5.i s, b.i u, b.j v from m5 join b on b.i = m5.j join m5 n on n.i = m5.i and n.j = b.j where n.w < 1e299 and abs(m5.w + b.w - n.w) <= 1e-9",
    "pa": "select i s, i v, 1.0::double c from nodes union all select pa.s, st.v, pa.c from pa join st on st.s = pa.s and st.u = pa.v",
    "pn": "select s, v, sum(c) c from pa group by all",
    "bt": "select x.v i, sum(x.c * y.c / z.c) q from pn x join pn y on y.s = x.v join pn z on z.s = x.s and z.v = y.v join m5 a on a.i = x.s and a.j = x.v join m5 c on c.i = x.v and c.j = y.v join m5 o on o.i = x.s and o.j = y.v where x.s <> x.v and x.v <> y.v and x.s <> y.v and abs(a.w + c.w - o.w) <= 1e-9 group by x.v",
}
query("betweenness_wei", with_("trade", "nodes", **_WEIGHTED, recursive=True, body=f"select n.i, {r6('coalesce(q, 0.0)')} betweenness from nodes n left join bt using (i)"))(
    lambda s, d: rounded(gp.betweenness_centrality(_top(s, d, 0.2, prep.invert), True).select("i", "betweenness"), "betweenness")
)
_TREE = {
    "e": top_sql(0.2),
    "rk": "select i, j, w / max(w) over () w, row_number() over (order by w desc, i desc, j desc) r from e",
    "dm": "select i, j, r from rk union all select j, i, r from rk union all select i, i, 0 from nodes",
    **_closure("dm", "select x.i, y.j, min(greatest(x.r, y.r)) r from {x} x join {x} y on x.j = y.i group by all"),
    "tr": "select rk.* from rk join m5 using (i, j) where rk.r = m5.r",
    "re": "select *, row_number() over (order by r) q from rk where r not in (select r from tr)",
}
query("backbone", with_("trade", "nodes", **_TREE, body=f"select i, j, {r6('w')} w from tr union all select i, j, {r6('w')} from re where q <= 2 * (select count(*) from nodes) - (select count(*) from tr)"))(
    lambda s, d: rounded(gp.backbone_edges(_w(s, d), 4).select("i", "j", "w"), "w")
)


def _sorted_weights(edges, *keys: str):
    """The weights in descending order, whatever edges bear them."""
    from pyspark.sql import Window

    return edges.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"))).cast("long").alias("place"), "w")


def _ringed(s, edges):
    far = F.least(F.col("j") - F.col("i"), F.lit(25) - (F.col("j") - F.col("i")))
    kept = _sorted_weights(edges.filter(far <= 3))
    return kept.withColumn("ring", F.lit("within 3"))


query("swp")(lambda s, d: rounded(gp.small_world_propensity(_w(s, d)), "propensity", "delta_c", "delta_l", "alpha", "delta"))
query("sigma")(lambda s, d: rounded(gp.small_world_sigma(_w(s, d)), "sigma"))
query("randomise")(lambda s, d: prep.randomise(_w(s, d), 3))
query("regular")(lambda s, d: gp.regular_lattice(_w(s, d), 3))
query("louvain")(lambda s, d: gp.communities(_w(s, d)))
query("regular_weights", t_sql(f"select row_number() over (order by w desc) place, {r6('w')} w, 'within 3' ring from u"))(
    lambda s, d: rounded(_ringed(s, gp.regular_lattice(_w(s, d), 3)), "w")
)
query("nsp_partition")(lambda s, d: rounded(gp.partition_levels(fx.signed(s, d)).select("level", "modules", "share", "h"), "share", "h"))
query("nsp")(lambda s, d: rounded(gp.nested_partition(fx.signed(s, d))[1], "h_int", "h_seg", "h_bal"))
query("nsp_levels")(lambda s, d: gp.nested_partition(fx.signed(s, d))[0])


def flagship(s, d):
    """Daily event panel, sliding-window correlation, density threshold, degree of each event type in each window."""
    from chronomesh.operators.dynamic import sliding_window

    edges = sliding_window(fx.daily(s, d), 7).withColumn("w", F.round("w", 6)).filter("w is not null")
    g = Graph(edges, fx.daily(s, d).select(F.col("roi").alias("i")).distinct()).pipe(prep.threshold_density, 0.4)
    return gm.degrees(g).select("t", "i", "degree")


_WIN = {"p": pairs_sql("daily"), "k": "select p.*, cast(k as bigint) k from p join (select unnest(range(24)) k) g on t between k and k + 6", "s": f"select k t, i, j, {_SUMS} from k group by all",
    "c": f"select t, i, j, round({corr_sql()}, 6) w from s", "r": "select *, row_number() over (partition by t order by w desc, i desc, j desc) n from c where w is not null and w <> 0",
    "q": "select *, case when w < 0 then 10 - count(*) over (partition by t) else 0 end z from r", "x": "select t, unnest([i, j]) i from q where n + z <= 4"}
query("flagship", with_("daily", **_WIN, body="select g.t, n.i, count(x.i) degree from (select distinct t from c where w is not null) g cross join (select distinct roi i from daily) n left join x on x.t = g.t and x.i = n.i group by g.t, n.i"))(flagship)
