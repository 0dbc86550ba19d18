"""Queries over panels: cleaning, static, time-resolved, phase-based and recursive connectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.operators import dynamic, edges, panel, phase, recursive, static, wavelet
from chronomesh.plans import fixtures as fx
from chronomesh.plans.fixtures import corr_sql, pairs_sql, r6, with_
from chronomesh.plans.registry import query, rounded

PAIRS = "subject, t, i, j"

# --- panels ---

query("panel_daily", with_("daily", body=f"select t, roi, {r6('x')} x from daily"))(lambda s, d: rounded(fx.daily(s, d).select("t", "roi", "x"), "x"))
query("panel_hourly", with_("hourly", body=f"select t, roi, {r6('x')} x from hourly"))(lambda s, d: rounded(fx.hourly(s, d).select("t", "roi", "x"), "x"))
query("panel_zscore", with_("subj", body=f"select subject, t, roi, {r6('(x - avg(x) over w) / case when stddev_pop(x) over w = 0 then 1.0 else stddev_pop(x) over w end')} x from subj window w as (partition by subject, roi)"))(
    lambda s, d: rounded(panel.standardise(fx.subjects(s, d)), "x")
)
query("panel_detrend", with_("subj", body=f"select subject, t, roi, {r6('x - avg(x) over w - (t - avg(t) over w) * covar_pop(x, t) over w / var_pop(t) over w')} x from subj window w as (partition by subject, roi)"))(
    lambda s, d: rounded(panel.detrend(fx.subjects(s, d)), "x")
)
query("panel_global_signal", with_("subj", g="select *, avg(x) over (partition by subject, t) g from subj", body=f"""select subject, t, roi, {r6('x - avg(x) over w - (g - avg(g) over w) * covar_pop(x, g) over w / case when var_pop(g) over w = 0 then 1.0 else var_pop(g) over w end')} x
    from g window w as (partition by subject, roi)"""))(lambda s, d: rounded(panel.regress_global_signal(fx.subjects(s, d)), "x"))
query("panel_discard", with_("daily", body=f"select subject, t - 5 t, roi, {r6('x')} x from daily where t >= 5"))(lambda s, d: rounded(panel.discard_initial(fx.daily(s, d), 5), "x"))
query("panel_shapes", with_("subj", body="select subject, count(distinct t) times, count(distinct roi) rois, count(x) = count(distinct t) * count(distinct roi) complete from subj group by subject"))(lambda s, d: panel.check_shapes(fx.subjects(s, d)))


def _vertices(s, d):
    """Monthly quantity by part (vertex); brands are parcels."""
    date = F.col("l_shipdate").cast("date")
    t = ((F.year(date) - 1995) * 12 + F.month(date) - 1).cast("long")
    rows = fx.read(s, d, "lineitem").groupBy(F.lit(0).cast("long").alias("subject"), t.alias("t"), F.col("l_partkey").alias("vertex")).agg(F.sum("l_quantity").alias("x"))
    brand = F.substring_index("p_brand", "#", -1).cast("long")
    return rows, fx.read(s, d, "part").select(F.col("p_partkey").alias("vertex"), brand.alias("parcel")), fx.read(s, d, "part").select(brand.alias("parcel")).distinct().union(s.range(900, 901).toDF("parcel"))


_VERTICES = {
    "v": "select cast(0 as bigint) subject, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 t, l_partkey vertex, sum(l_quantity) x from lineitem group by all",
    "z": "select subject, t, vertex, (x - avg(x) over w) / case when stddev_pop(x) over w = 0 then 1.0 else stddev_pop(x) over w end x from v window w as (partition by subject, vertex)",
    "a": "select p_partkey vertex, cast(split_part(p_brand, '#', 2) as bigint) parcel from part",
    "p": "select distinct parcel from a union all select 900",
}
query("parcellate_mean", with_(**_VERTICES, body=f"""select c.subject, c.t, p.parcel, {r6('coalesce(m.x, 0.0)')} x from (select distinct subject, t from z) c cross join p
    left join (select subject, t, parcel, avg(x) x from z join a using (vertex) group by all) m on m.subject = c.subject and m.t = c.t and m.parcel = p.parcel"""))(
    lambda s, d: rounded(panel.parcellate(*_vertices(s, d)), "x")
)
query("atlas_renumber", "select p_partkey vertex, coalesce(k, 0) parcel from part left join (select b, row_number() over (order by b) + 10 k from (select distinct cast(split_part(p_brand, '#', 2) as bigint) b from part) where b > 3) on b = cast(split_part(p_brand, '#', 2) as bigint)")(
    lambda s, d: panel.renumber(_vertices(s, d)[1], skip=3, offset=10)
)


def _labels(s, d):
    head = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Thalamus"), F.when(F.col("c_custkey") % 2 == 0, "-lh").otherwise("-rh"))).otherwise(
        F.concat(F.lit("17networks_"), F.when(F.col("c_custkey") % 2 == 0, "LH").otherwise("RH"), F.lit("_"), F.initcap("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string"))
    )
    return fx.read(s, d, "customer").select(head.alias("label"))


query("networks_from_labels", """with l as (select case when c_custkey % 7 = 0 then 'Thalamus' || case when c_custkey % 2 = 0 then '-lh' else '-rh' end
    else '17networks_' || case when c_custkey % 2 = 0 then 'LH' else 'RH' end || '_' || c_mktsegment[1] || lower(c_mktsegment[2:]) || '_' || c_custkey end label,
    case when c_custkey % 7 = 0 then 'Subcortical' else c_mktsegment[1] || lower(c_mktsegment[2:]) end network from customer)
    select label, network, case when network = 'Subcortical' then 0 else dense_rank() over (order by network = 'Subcortical', network) end network_id from l""")(lambda s, d: panel.networks(_labels(s, d)))
query("segment_average", with_("hourly", seg="select k segment, k * 24 + 3 a, k * 24 + 9 b from (select unnest(range(29)) k)", body=f"select segment, roi, {r6('avg(x)')} x from hourly join seg on t between a and b group by segment, roi"))(
    lambda s, d: rounded(panel.segment_average(fx.hourly(s, d), s.range(29).selectExpr("id as segment", "id * 24 + 3 as first_t", "id * 24 + 9 as last_t")), "x")
)
query("butterworth")(lambda s, d: rounded(panel.clean(fx.hourly(s, d), detrended=True, standardised=True, low_pass=1 / 20_000, high_pass=1 / 500_000, t_r=3600.0), "x"))


def _confounds(s, d):
    return fx.subjects(s, d).filter("roi = 'error'").selectExpr("subject", "t", "'error' as name", "x")


query("clean_confound", with_("subj", c="select subject, t, x c from subj where roi = 'error'", j="select subj.*, c.c from subj join c using (subject, t)", body=f"""select subject, t, roi,
    {r6('x - avg(x) over w - (c - avg(c) over w) * covar_pop(x, c) over w / case when var_pop(c) over w = 0 then 1.0 else var_pop(c) over w end')} x from j window w as (partition by subject, roi)"""))(
    lambda s, d: rounded(panel.clean(fx.subjects(s, d), confounds=_confounds(s, d)), "x")
)

# --- static ---

_SUMS = "count(*) n, sum(x) sx, sum(y) sy, sum(x * y) sxy, sum(x * x) sxx, sum(y * y) syy"


def _static(source: str, keys: str = "subject, i, j") -> dict[str, str]:
    return {"p": pairs_sql(source), "s": f"select {keys}, {_SUMS} from p group by all"}


query("fc_pearson", with_("hourly", **_static("hourly"), body=f"select subject, i, j, {r6(corr_sql())} w from s"))(lambda s, d: rounded(static.pearson(fx.hourly(s, d)), "w"))
query("fc_pearson_fisher", with_("subj", **_static("subj"), body=f"select subject, i, j, {r6('atanh(greatest(-1 + 2.220446049250313e-16, least(1 - 2.220446049250313e-16, ' + corr_sql() + ')))')} w from s"))(
    lambda s, d: rounded(static.pearson(fx.subjects(s, d), fisher=True), "w")
)
query("fc_pooled", with_("subj", p=pairs_sql("subj"), s=f"select i, j, {_SUMS} from p group by all", body=f"select i, j, {r6(corr_sql())} w from s"))(lambda s, d: rounded(static.pearson(fx.subjects(s, d), pooled=True).drop("subject"), "w"))
query("fc_covariance", with_("subj", p=pairs_sql("subj", True), body=f"select subject, i, j, {r6('covar_samp(x, y)')} w from p group by all"))(lambda s, d: rounded(static.covariance(fx.subjects(s, d), diagonal=True), "w"))
query("fc_mutual_info", with_("subj", b="select subject, t, roi, case when lo = hi then 1 when x = hi then 11 else least(10, 1 + floor((x - lo) / ((hi - lo) / 10))) end x from (select *, min(x) over w lo, max(x) over w hi from subj window w as (partition by subject, roi))",
    p=pairs_sql("b"), c="select subject, i, j, x, y, cast(count(*) as double) n from p group by all",
    q="select subject, i, j, n / sum(n) over w pxy, sum(n) over (partition by subject, i, j, x) / sum(n) over w px, sum(n) over (partition by subject, i, j, y) / sum(n) over w py from c window w as (partition by subject, i, j)",
    body=f"select subject, i, j, {r6('sum(pxy * ln(pxy / (px * py)))')} w from q group by all"))(lambda s, d: rounded(static.mutual_information(fx.subjects(s, d)), "w"))
query("fc_ledoit_wolf", with_("subj", c="select subject, t, roi, x - avg(x) over (partition by subject, roi) x from subj", p=pairs_sql("c", True),
    s="select subject, i, j, sum(x * y) / count(*) s, count(*) n, case when i = j then 1.0 else 2.0 end m from p group by all",
    q="select subject, sum(q * q) b from (select subject, t, sum(x * x) q from c group by all) group by all",
    k="select subject, sum(case when i = j then s end) tr, sum(m * s * s) dd, sum(case when i = j then 1.0 else 0.0 end) pp, max(n) n from s group by all",
    z="select subject, tr / pp mu, (b / n - dd) / (n * pp) beta, (dd - 2 * tr * tr / pp + pp * (tr / pp) * (tr / pp)) / pp delta from k join q using (subject)",
    body=f"select subject, i, j, {r6('(1 - least(beta, delta) / delta) * s + case when i = j then least(beta, delta) / delta * mu else 0.0 end')} w from s join z using (subject)"))(
    lambda s, d: rounded(static.covariance(fx.subjects(s, d), "LedoitWolf", diagonal=True), "w")
)


def _swept(variables: int) -> dict[str, str]:
    """Sweeps of a covariance table (subject, i, j, v) with places 1.. on all variables in turn: what is left is minus the inverse."""
    step = """select a.subject, a.i, a.j, case when a.i = {k} and a.j = {k} then -1 / d.v when a.i = {k} or a.j = {k} then a.v / d.v else a.v - b.v * c.v / d.v end v
        from {x} a join {x} d on d.subject = a.subject and d.i = {k} and d.j = {k} join {x} b on b.subject = a.subject and b.i = a.i and b.j = {k} join {x} c on c.subject = a.subject and c.i = {k} and c.j = a.j"""
    return {f"w{k}": step.format(k=k, x=f"w{k - 1}") for k in range(1, variables + 1)}


query("fc_partial", with_("subj", nm="select roi, row_number() over (order by roi) k from (select distinct roi from subj)", r="select subject, t, k, x from subj join nm using (roi)",
    w0="select a.subject, a.k i, b.k j, covar_samp(a.x, b.x) v from r a join r b on a.subject = b.subject and a.t = b.t group by all", **_swept(5), once=True,
    body=f"select a.subject, p.roi i, q.roi j, {r6('a.v / sqrt(d.v * e.v)')} w from w5 a join w5 d on d.subject = a.subject and d.i = a.i and d.j = a.i join w5 e on e.subject = a.subject and e.i = a.j and e.j = a.j join nm p on p.k = a.i join nm q on q.k = a.j where a.i < a.j"))(
    lambda s, d: rounded(static.partial(fx.subjects(s, d)), "w")
)

# --- windows ---


def _windows(source: str, size: int, step: int = 1, weight: str = "1.0", last: int = fx.DAYS) -> dict[str, str]:
    return {
        "p": pairs_sql(source),
        "k": f"select p.*, cast(k as bigint) k, t - k * {step} o from p join (select unnest(range({(last - size) // step + 1})) k) g on t between k * {step} and k * {step} + {size - 1}",
        "v": f"select *, cast({weight} as double) h from k",
        "s": "select subject, k t, i, j, sum(h) n, sum(h * x) sx, sum(h * y) sy, sum(h * x * y) sxy, sum(h * x * x) sxx, sum(h * y * y) syy from v group by all",
    }


_CORR = f"select {PAIRS}, {r6(corr_sql())} w from s"
query("sw_rect", with_("daily", **_windows("daily", 7), body=_CORR))(lambda s, d: rounded(dynamic.sliding_window(fx.daily(s, d), 7), "w"))
query("sw_hourly", with_("hourly", **_windows("hourly", 29, last=fx.HOURS), body=_CORR))(lambda s, d: rounded(dynamic.sliding_window(fx.hourly(s, d), 29), "w"))
query("sw_gaussian", with_("daily", **_windows("daily", 11, 1, "exp(-0.5 * pow((o - 5.0) / 3.0, 2))"), body=_CORR))(lambda s, d: rounded(dynamic.sliding_window(fx.daily(s, d), 11, 1, "gaussian", 3.0), "w"))
query("sw_hamming", with_("daily", **_windows("daily", 11, 1, "0.54 - 0.46 * cos(6.283185307179586 * o / 10.0)"), body=_CORR))(lambda s, d: rounded(dynamic.sliding_window(fx.daily(s, d), 11, 1, "hamming"), "w"))
query("sw_step", with_("daily", **_windows("daily", 10, 4), body=_CORR))(lambda s, d: rounded(dynamic.sliding_window(fx.daily(s, d), 10, 4), "w"))
query("sw_multi_subject", with_("subj", **_windows("subj", 7), body=_CORR))(lambda s, d: rounded(dynamic.sliding_window(fx.subjects(s, d), 7), "w"))
query("sw_centers", "select cast(0 as bigint) subject, cast(k as bigint) t, cast(k * 4 + 5 as bigint) centre from (select unnest(range(6)) k)")(lambda s, d: dynamic.centres(fx.daily(s, d), 10, 4))
query("jackknife", with_("daily", p=pairs_sql("daily"), k="select p.*, cast(k as bigint) k from p join (select unnest(range(28)) k) g on t < k or t > k + 2",
    s=f"select subject, k t, i, j, {_SUMS} from k group by all", body=f"select {PAIRS}, {r6('-(' + corr_sql() + ')')} w from s"))(lambda s, d: rounded(dynamic.jackknife(fx.daily(s, d), 3), "w"))
query("mtd", with_("daily", dx="select * from (select subject, t, roi, x - lag(x) over (partition by subject, roi order by t) x from daily) where x is not null",
    z="select subject, t, roi, x / stddev_pop(x) over (partition by subject, roi) x from dx", p=pairs_sql("z"),
    m="select subject, t - 1 t, i, j, avg(x * y) over w w, count(*) over w n from p window w as (partition by subject, i, j order by t rows between current row and 6 following)",
    body=f"select {PAIRS}, {r6('w')} w from m where n = 7"))(lambda s, d: rounded(dynamic.temporal_derivatives(fx.daily(s, d), 7), "w"))

for _name, _dist in {"euclidean": "sqrt(sum((a.x - b.x) * (a.x - b.x)))", "cityblock": "sum(abs(a.x - b.x))", "cosine": "1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x))"}.items():
    query(f"spatial_{_name}", with_("daily", g=f"select a.subject, a.t, b.t s, 1 / ({_dist}) g from daily a join daily b on a.subject = b.subject and a.roi = b.roi and a.t <> b.t group by all",
        h="select subject, t, s, (g - min(g) over ()) / (max(g) over () - min(g) over ()) h from g union all select distinct subject, t, t, 1.0 from daily",
        p=pairs_sql("daily"), s="select p.subject, h.t, i, j, sum(h) n, sum(h * x) sx, sum(h * y) sy, sum(h * x * y) sxy, sum(h * x * x) sxx, sum(h * y * y) syy from p join h on h.subject = p.subject and h.s = p.t group by all",
        body=_CORR))((lambda k: lambda s, d: rounded(dynamic.spatial_distance(fx.daily(s, d), k), "w"))(_name))

# --- phases and edges ---

_HALF = (fx.DAYS - 1) // 2
_KERNEL = "(2.0 / n) * list_sum(list_transform(range(1, cast(case when n % 2 = 1 then (n - 1) // 2 else n // 2 - 1 end as bigint) + 1), lambda m: sin(2 * pi() * m * ((d % n + n) % n) / n)))"


def _phase(source: str, n: int) -> dict[str, str]:
    kernel = _KERNEL.replace("n %", f"{n} %").replace("(n -", f"({n} -").replace("n //", f"{n} //").replace("/ n)", f"/ {n})").replace("% n", f"% {n}").replace("+ n)", f"+ {n})")
    return {
        "ker": f"select d, {kernel} k from (select unnest(range({n})) d)",
        "hil": f"select a.subject, a.t, a.roi, any_value(a.x) x, sum(b.x * k) h from {source} a join {source} b on a.subject = b.subject and a.roi = b.roi join ker on d = (a.t - b.t + {n}) % {n} group by all",
        "ph": "select subject, t, roi, atan2(h, x) x from hil",
    }


query("hilbert_phase", with_("daily", **_phase("daily", fx.DAYS), body=f"select subject, t, roi, {r6('x')} phase from ph"))(lambda s, d: rounded(phase.analytic_phase(fx.daily(s, d)), "phase"))
for _name, _form in {"crp": "cos(x - y)", "phcoh": "1 - abs(sin(x - y))", "teneto": "1 - sin(abs(x - y) / 2)"}.items():
    query(f"ps_{_name}", with_("daily", **_phase("daily", fx.DAYS), p=pairs_sql("ph"), body=f"select {PAIRS}, {r6(_form)} w from p"))((lambda k: lambda s, d: rounded(phase.phase_synchronisation(fx.daily(s, d), k), "w"))(_name))
_LEIDA = {
    "cs": "select subject, t, roi, cos(x) c, sin(x) s from ph",
    "q": "select *, sum(c * c) over w a, sum(c * s) over w b, sum(s * s) over w d from cs window w as (partition by subject, t)",
    "u": "select subject, t, roi, (((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2) - d) * c + b * s v from q",
    "v0": "select subject, t, roi, v / sqrt(sum(v * v) over (partition by subject, t)) x from u",
    "v1": "select subject, t, roi, case when avg(case when x > 0 then 1.0 else 0.0 end) over (partition by subject, t) > 0.5 then -x else x end x from v0",
}
query("leida_outer", with_("daily", **_phase("daily", fx.DAYS), **_LEIDA, p=pairs_sql("v1"), body=f"select {PAIRS}, {r6('x * y')} w from p"))(lambda s, d: rounded(phase.leida(fx.daily(s, d)), "w"))
query("leida_v1", with_("daily", **_phase("daily", fx.DAYS), **_LEIDA, body=f"select subject, t, roi, {r6('x')} v from v1"))(lambda s, d: rounded(phase.leading_eigenvectors(fx.daily(s, d)), "v"))

_ETS = {"z": "select subject, t, roi, (x - avg(x) over w) / stddev_samp(x) over w x from embed window w as (partition by subject, roi)", "p": pairs_sql("z"), "e": f"select {PAIRS}, x * y w from p"}
query("edge_ts", with_("embed", **_ETS, body=f"select {PAIRS}, {r6('w')} w from e"))(lambda s, d: rounded(edges.edge_series(fx.embed(s, d)), "w"))
query("edge_rms", with_("embed", **_ETS, body=f"select subject, t, {r6('sqrt(avg(w * w))')} rms from e group by all"))(lambda s, d: rounded(edges.edge_rms(edges.edge_series(fx.embed(s, d))), "rms"))
query("edge_fc", with_("subj", **{k: v.replace("embed", "subj") for k, v in _ETS.items()}, body=f"""select a.subject, a.i i1, a.j j1, b.i i2, b.j j2, {r6('sum(a.w * b.w) / sqrt(sum(a.w * a.w) * sum(b.w * b.w))')} w
    from e a join e b on a.subject = b.subject and a.t = b.t and (a.i, a.j) < (b.i, b.j) group by all"""))(lambda s, d: rounded(edges.edge_connectivity(edges.edge_series(fx.subjects(s, d))), "w"))
query("edge_labels", with_("daily", body="select distinct a.roi i, b.roi j, a.roi || '–' || b.roi as label from daily a join daily b on a.roi < b.roi"))(lambda s, d: edges.edge_labels(edges.edge_series(fx.daily(s, d))))
query("edges_lower", with_("daily", **_static("daily"), body=f"select j i, i j, {r6(corr_sql())} w from s"))(lambda s, d: rounded(edges.lower_triangle(static.pearson(fx.daily(s, d))).drop("subject"), "w"))
query("edges_mirrored", with_("daily", **_static("daily"), c=f"select i, j, {r6(corr_sql())} w from s", body="select i, j, w from c union all select j, i, w from c union all select distinct roi, roi, 1.0 from daily"))(
    lambda s, d: rounded(edges.mirrored(static.pearson(fx.daily(s, d)).drop("subject"), F.lit(1.0), fx.daily(s, d).select(F.col("roi").alias("i")).distinct()), "w")
)

# --- recursions ---

query("fls_beta", with_("daily", z="select subject, t, roi, (x - avg(x) over w) / stddev_pop(x) over w x from daily window w as (partition by subject, roi)",
    p="select a.t, a.roi i, b.roi j, a.x, b.x y from z a join z b on a.t = b.t and a.roi <> b.roi",
    fwd="""select t, i, j, -100.0 / (x * x + 100.0) c, x * y / (x * x + 100.0) d from p where t = 0 union all
        select p.t, p.i, p.j, -100.0 / (p.x * p.x + case when p.t = 29 then 100.0 else 200.0 end + 100.0 * f.c), (p.x * p.y + 100.0 * f.d) / (p.x * p.x + case when p.t = 29 then 100.0 else 200.0 end + 100.0 * f.c)
        from fwd f join p on p.t = f.t + 1 and p.i = f.i and p.j = f.j""",
    bwd="select t, i, j, d b from fwd where t = 29 union all select f.t, f.i, f.j, f.d - f.c * b.b from bwd b join fwd f on f.t = b.t - 1 and f.i = b.i and f.j = b.j", recursive=True,
    body=f"select cast(0 as bigint) subject, a.t, a.i, a.j, {r6('(a.b + b.b) / 2')} w from bwd a join bwd b on a.t = b.t and a.i = b.j and a.j = b.i where a.i < a.j"))(
    lambda s, d: rounded(recursive.flexible_least_squares(fx.daily(s, d)), "w")
)
_THETA = (50.0, 0.1, 0.8)
query("garch_filter", with_("daily", g="select t, roi, x, avg(x * x) over (partition by roi) h0 from daily",
    h=f"select t, roi, x, h0 h from g where t = 0 union all select g.t, g.roi, g.x, {_THETA[0]} + {_THETA[1]} * h.x * h.x + {_THETA[2]} * h.h from h join g on g.t = h.t + 1 and g.roi = h.roi", recursive=True,
    body="select cast(0 as bigint) subject, t, roi, round(h, 3) + 0.0 h from h"))(lambda s, d: rounded(recursive.garch_filter(fx.daily(s, d), _THETA), "h", digits=3))
_Z3 = "select t, roi, (x - avg(x) over w) / stddev_samp(x) over w x from daily window w as (partition by roi)"
query("dcc_filter", with_("daily", z=_Z3, p="select a.t, a.roi i, b.roi j, a.x, b.x y from z a join z b on a.t = b.t and a.roi <= b.roi", c="select i, j, corr(x, y) s from p group by all",
    u="select t, i, j, s, s * (1 - 0.05 - 0.9) + 0.05 * x * y + 0.9 * s q from p join c using (i, j) where t = 0",
    dg="""select t, i roi, (1 - 0.05 - 0.9) + 0.05 * x * x + 0.9 q from p where t = 0 and i = j union all select p.t, p.i, 1e0 * (1 - 0.05 - 0.9) + 0.05 * p.x * p.x * dg.q + 0.9 * dg.q from dg join p on p.t = dg.t + 1 and p.i = p.j and p.i = dg.roi""",
    rec="""select t, i, j, s, q from u union all select p.t, r.i, r.j, r.s, r.s * (1 - 0.05 - 0.9) + 0.05 * p.x * sqrt(di.q) * p.y * sqrt(dj.q) + 0.9 * r.q
        from rec r join p on p.t = r.t + 1 and p.i = r.i and p.j = r.j join dg di on di.roi = r.i and di.t = r.t join dg dj on dj.roi = r.j and dj.t = r.t""", recursive=True,
    body=f"select cast(0 as bigint) subject, r.t, r.i, r.j, {r6('r.q / sqrt(di.q * dj.q)')} w from rec r join dg di on di.roi = r.i and di.t = r.t join dg dj on dj.roi = r.j and dj.t = r.t where r.i < r.j"))(
    lambda s, d: rounded(recursive.dcc_filter(panel.standardise(fx.daily(s, d), 1), 0.05, 0.9), "w")
)
query("dcc_parameters")(lambda s, d: rounded(recursive.dcc_parameters(recursive.garch_residuals(fx.subjects(s, d))), "a", "b", digits=3))
query("dcc_fit")(lambda s, d: rounded(recursive.dynamic_conditional_correlation(fx.daily(s, d)), "w", "h", digits=4))
query("wavelet")(lambda s, d: rounded(wavelet.wavelet_coherence(fx.hourly(s, d)), "w"))
query("wavelet_scales")(lambda s, d: rounded(wavelet.coherence_by_scale(fx.daily(s, d), 1.0, 0.05, 0.4, 6), "period", "c"))
