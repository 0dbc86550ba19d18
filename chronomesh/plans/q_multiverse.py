"""Queries over a multiverse of order statistics: 192 universes evaluated in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.stats import clean_zero, exact_medians
from chronomesh.operators import multiverse as mv
from chronomesh.plans import fixtures as fx
from chronomesh.plans.fixtures import r6
from chronomesh.plans.registry import query, rounded
from chronomesh.sources.shared import stored

DECISIONS = {
    "status": ["all", "F", "O", "P"],
    "price": ["total", "net"],
    "agg": ["mean", "median"],
    "trim": ["none", "drop3"],
    "segment": ["all", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}
NAMES = list(DECISIONS)
EXCLUSIONS = [[{"price": "net"}, {"agg": "median"}, "trim"], [{"status": ["O", "P"]}, "segment"]]
REMOVALS = [[{"status": ["F", "O"]}, {"trim": "drop3"}], ["trim", {"segment": "FURNITURE"}]]
ORDERS = [["status", "price", "agg"], ["agg", "status", "trim"]]


def space(s) -> DataFrame:
    return mv.create(s, DECISIONS)


def outcomes(s, d) -> DataFrame:
    """(universe, decisions.., outcome, n): every order joins the groups it belongs to, then one aggregate serves all universes.

    The orders are written once, each row with a number of its own: sums of line items are of another last bit whenever they are
    summed anew, and several passes have to meet the same values. The number tells the rows of a repeated order apart.
    """
    net = fx.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    orders = fx.read(s, d, "orders").join(fx.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(net, F.col("o_orderkey") == F.col("l_orderkey"))
    orders = stored(orders.select(F.monotonically_increasing_id().alias("row"), "o_orderkey", "o_orderstatus", "c_mktsegment", "o_totalprice", "net"), "orders")
    prices = F.array(F.struct(F.lit("total").alias("p"), F.col("o_totalprice").alias("v")), F.struct(F.lit("net").alias("p"), F.col("net").alias("v")))
    rows = orders.select("row", "o_orderkey", F.explode(F.array(F.lit("all"), "o_orderstatus")).alias("status"), "c_mktsegment", prices.alias("prices"))
    rows = rows.select("row", "o_orderkey", "status", F.explode(F.array(F.lit("all"), "c_mktsegment")).alias("segment"), "prices")
    rows = rows.select("row", "o_orderkey", "status", "segment", F.explode("prices").alias("q")).select("row", "o_orderkey", "status", "segment", F.col("q.p").alias("price"), F.col("q.v").alias("v"))
    keys = ["status", "price", "segment"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), "o_orderkey", "row"))).filter("rank <= 3")
    top = ranked.groupBy(*keys).agg(F.collect_list("row").alias("top"))
    marked = rows.join(F.broadcast(top), keys)  # one row per group of decisions
    kept = marked.withColumn("trim", F.explode(F.when(F.array_contains("top", F.col("row")), F.array(F.lit("none"))).otherwise(F.array(F.lit("none"), F.lit("drop3")))))
    sums = kept.groupBy(*keys, "trim").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    sums = sums.join(exact_medians(kept, [*keys, "trim"], "v"), [*keys, "trim"], "left")
    long = sums.unpivot([*keys, "trim", "n"], ["mean", "median"], "agg", "outcome")
    return F.broadcast(space(s)).join(long, NAMES, "left").select("universe", *NAMES, F.round("outcome", 6).alias("outcome"), F.col("n").alias("n"))


def results(s, d) -> DataFrame:
    """The outcomes, written once: what weighs and compares universes reads them several times."""
    return stored(outcomes(s, d).withColumn("bic", F.round(F.col("outcome") / 5000, 6)), "outcomes")


def _options(k: str) -> str:
    return f"(select unnest({DECISIONS[k]!r}) {k}, unnest(range(1, {len(DECISIONS[k]) + 1})) p_{k})"


SPACE = f"""select row_number() over (order by p_status, p_price, p_agg, p_trim, p_segment) universe, {', '.join(NAMES)}
    from {' cross join '.join(_options(k) for k in NAMES)}"""
RUN = {
    "nets": "select l_orderkey k, sum(l_extendedprice * (1 - l_discount)) net from lineitem group by 1",
    "o": "select o_orderkey k, o_orderstatus s, c_mktsegment g, o_totalprice total, net from orders join customer on o_custkey = c_custkey join nets on nets.k = o_orderkey",
    "o1": "select k, unnest(['all', s]) status, g, total, net from o",
    "o2": "select k, status, unnest(['all', g]) segment, total, net from o1",
    "o3": "select k, status, segment, 'total' price, total v from o2 union all select k, status, segment, 'net', net from o2",
    "rk": "select *, row_number() over (partition by status, segment, price order by v desc, k) rn from o3",
    "tr": "select status, segment, price, 'none' trim, v from rk union all select status, segment, price, 'drop3', v from rk where rn > 3",
    "ag": "select status, segment, price, trim, avg(v) m1, median(v) m2, count(*) n from tr group by all",
    "sp": SPACE,
    "res": f"select universe, {', '.join('sp.' + k for k in NAMES)}, round(case agg when 'mean' then m1 else m2 end, 6) outcome, n from sp left join ag using (status, segment, price, trim)",
    "rb": "select *, round(outcome / 5000, 6) bic from res",
}


def run_sql(body: str, **more: str) -> str:
    return "with " + ", ".join(f"{k} as ({v})" for k, v in (RUN | more).items()) + " " + body


def space_sql(body: str, **more: str) -> str:
    return "with " + ", ".join(f"{k} as ({v})" for k, v in ({"sp": SPACE} | more).items()) + " " + body


_COLS = ", ".join(NAMES)
_KEYS = "coalesce(status, ''), coalesce(price, ''), coalesce(agg, ''), coalesce(trim, ''), coalesce(segment, '')"
_EXCL = "select universe, status, price, agg, case when price = 'net' and agg = 'median' then null else trim end trim, case when status in ('O', 'P') then null else segment end segment from sp"
_DEDUP = f"select * from (select *, row_number() over (partition by {_KEYS} order by universe) q from ex) where q = 1"
_REMOVED = "not (coalesce(status in ('F', 'O'), false) and coalesce(trim = 'drop3', false)) and not (trim is not null and coalesce(segment = 'FURNITURE', false))"

query("mv_product", space_sql(f"select universe, {_COLS} from sp"))(lambda s, d: space(s).drop("order_id"))
query("mv_exclude", space_sql(f"select universe, {_COLS} from ex", ex=_EXCL))(lambda s, d: mv.create(s, DECISIONS, exclusions=EXCLUSIONS).drop("order_id"))
query("mv_dedup", space_sql(f"select row_number() over (order by universe) universe, {_COLS} from dd", ex=_EXCL, dd=_DEDUP))(lambda s, d: mv.create(s, DECISIONS, exclusions=EXCLUSIONS, dedup="all").drop("order_id"))
query("mv_remove", space_sql(f"select row_number() over (order by universe) universe, {_COLS} from dd where {_REMOVED}", ex=_EXCL, dd=_DEDUP))(
    lambda s, d: mv.create(s, DECISIONS, exclusions=EXCLUSIONS, removals=REMOVALS, dedup="all").drop("order_id")
)


def _order_sql(k: int, used: list[str]) -> str:
    columns = ", ".join(c if c in used else f"'unused' {c}" for c in NAMES)
    return f"select {k} order_id, row_number() over (order by {', '.join('p_' + c for c in used)}) place, {columns} from {' cross join '.join(_options(c) for c in used)}"


query("mv_order", f"with u as ({' union all '.join(_order_sql(k, o) for k, o in enumerate(ORDERS))}) select row_number() over (order by order_id, place) universe, order_id, {_COLS} from u")(lambda s, d: mv.create(s, DECISIONS, orders=ORDERS))
query("mv_summary", space_sql(f"select universe, {_COLS} from sp where universe between 10 and 20"))(lambda s, d: mv.summary(space(s), range(10, 20)).drop("order_id"))
query("mv_expand", space_sql("select universe, pos, decision, value from (" + " union all ".join(f"select universe, {k + 1} pos, '{c}' decision, {c} as value from sp" for k, c in enumerate(NAMES)) + ")"))(lambda s, d: mv.long_decisions(space(s)))
query("mv_orders_run", run_sql(f"select universe, {_COLS}, outcome, n from res"))(outcomes)
query("mv_get_results", run_sql("select universe, outcome, n, " + ", ".join(f"{c} __{c}" for c in NAMES) + " from res"))(lambda s, d: mv.get_results(outcomes(s, d).select("universe", "outcome", "n"), space(s)))
query("mv_add", run_sql("select universe, outcome, universe * 2 twice from res"))(lambda s, d: mv.remove_results(mv.add_results(outcomes(s, d).select("universe", "outcome", "n"), space(s).selectExpr("universe", "universe * 2 as twice")), "n"))
query("mv_mean", run_sql(f"select {r6('avg(outcome)')} mean from res"))(lambda s, d: rounded(mv.integrate(results(s, d), "outcome"), "mean"))
_BMA = {"wb": "select *, exp(-(bic - min(bic) over ()) / 2) e from rb", "wt": "select universe, outcome, e / sum(e) over () w from wb"}
query("mv_bma", run_sql(f"select universe, round(w, 9) + 0.0 w from wt", **_BMA))(lambda s, d: mv.bma_weights(results(s, d), "bic").select("universe", clean_zero(F.col("w"), 9).alias("w")))
query("mv_wmedian", run_sql("select min(outcome) median from (select outcome, sum(w) over (order by outcome, universe) cw from wt) where cw >= 0.5 - 1e-12", **_BMA))(lambda s, d: mv.integrate(results(s, d), "outcome", "bma", "median", bic="bic"))
query("mv_gini", run_sql(f"select {r6('2 * sum(i * w) / (count(*) * sum(w)) - (count(*) + 1) / count(*)')} gini from (select w, row_number() over (order by w, universe) i from wt)", **_BMA))(lambda s, d: rounded(mv.gini(mv.bma_weights(results(s, d), "bic")), "gini"))
_LEVELS = " union all ".join(f"select '{c}' decision, {c} as level, avg(outcome) m from res group by {c}" for c in NAMES)
_MYH = {
    "lv": _LEVELS,
    "ef": "select decision, level, m - first_value(m) over (partition by decision order by level) b from lv",
    "al": "select (select avg(outcome) from res) - sum(b) a from (select decision, avg(b) b from ef group by decision)",
    "cj": "select universe, outcome, sqrt((select a * a from al) + " + " + ".join(f"(select b * b from ef where decision = '{c}' and level = res.{c})" for c in NAMES) + ") c from res",
}
query("mv_myh", run_sql("select universe, round(c / sum(c) over (), 9) + 0.0 w from cj", **_MYH))(lambda s, d: mv.myh_weights(results(s, d), "outcome", NAMES).select("universe", clean_zero(F.col("w"), 9).alias("w")))
query("mv_myhn", run_sql("select universe, round((max(c) over () - c) / (max(c) over () * count(*) over () - sum(c) over ()), 9) + 0.0 w from cj", **_MYH))(lambda s, d: mv.myh_weights(results(s, d), "outcome", NAMES, True).select("universe", clean_zero(F.col("w"), 9).alias("w")))
# a one-hot decision without its first level: leaving that level moves one column, changing between others moves two
_DIST = " + ".join(f"case when a.{c} = b.{c} then 0 when a.{c} = '{sorted(DECISIONS[c])[0]}' or b.{c} = '{sorted(DECISIONS[c])[0]}' then 1 else 2 end" for c in NAMES)
_MLI = {
    "pr": f"select a.universe, abs(a.outcome - b.outcome) ch, {_DIST} dist from res a join res b on a.universe <> b.universe",
    "nr": "select universe, max(ch) err from (select *, min(dist) over (partition by universe) least from pr) where dist = least group by universe",
}
query("mv_mli", run_sql("select universe, round((max(err) over () - err) / (max(err) over () * count(*) over () - sum(err) over ()), 9) + 0.0 w from nr", **_MLI))(lambda s, d: mv.mli_weights(results(s, d), "outcome", NAMES).select("universe", clean_zero(F.col("w"), 9).alias("w")))
_WEIGHTED = {
    "wu": "select 'uniform' method, universe, outcome, 1.0 / count(*) over () w from res",
    "wl": "select 'bma' method, universe, outcome, w from wt",
    "wm": "select 'myh' method, universe, outcome, c / sum(c) over () w from cj",
    "wn": "select 'myhn' method, universe, outcome, (max(c) over () - c) / (max(c) over () * count(*) over () - sum(c) over ()) w from cj",
    "wi": "select 'mli' method, universe, outcome, (max(err) over () - err) / (max(err) over () * count(*) over () - sum(err) over ()) w from nr join res using (universe)",
    "wa": "select * from wu union all select * from wl union all select * from wm union all select * from wn union all select * from wi",
    "wr": "select *, sum(w) over (partition by method order by outcome, universe) cw, row_number() over (partition by method order by w, universe) k, max(w) over (partition by method) hw from wa",
}


def _figures(x: str) -> str:
    return f"case when {x} = 0 then 0.0 else round_even({x} * pow(10.0, 2 - floor(log10(abs({x})))), 0) / pow(10.0, 2 - floor(log10(abs({x})))) end"


query("mv_compare", run_sql(f"""select method, {_figures('median')} median, {_figures('mean')} mean, {_figures('gini')} gini, {_figures('hw')} highest_w, u highest_universe, {_figures('median')} - 10000.0 median_error, {_figures('mean')} - 10000.0 mean_error
    from (select method, min(outcome) filter (where cw >= 0.5 - 1e-12) median, sum(w * outcome) mean, case when abs(g) < 1e-12 then 0.0 else g end gini, hw, case when n = 1 then u end u from
    (select *, 2 * sum(k * w) over p / (count(*) over p * sum(w) over p) - (count(*) over p + 1) / count(*) over p g, count(*) filter (where hw - w < 1e-12) over p n, min(universe) filter (where hw - w < 1e-12) over p u from wr window p as (partition by method))
    group by method, g, hw, n, u)""", **_BMA, **_MYH, **_MLI, **_WEIGHTED))(lambda s, d: mv.compare_integration(results(s, d), "outcome", NAMES, "bic", 10_000.0))
query("mv_curves", run_sql(f"""select method, k, round(x, 4) + 0.0 x, round(sum(w * exp(-((x - outcome) / h) * ((x - outcome) / h) / 2)) / any_value(h * sqrt(2 * pi()) * sw), 9) + 0.0 density from
    (select method, cast(k as integer) k, lo + (hi - lo) * k / 19.0 x, sw, sqrt((syy / sw - (sy / sw) * (sy / sw)) / (1 - sw2 / (sw * sw))) * pow(sw * sw / sw2, -0.2) h from
    (select method, min(outcome) lo, max(outcome) hi, sum(w) sw, sum(w * w) sw2, sum(w * outcome) sy, sum(w * outcome * outcome) syy from wa group by method) cross join (select unnest(range(20)) k)) join wa using (method) group by method, k, x""", **_BMA, **_MYH, **_MLI, **_WEIGHTED))(
    lambda s, d: mv.integration_curves(results(s, d), "outcome", NAMES, "bic", 20).select("method", "k", clean_zero(F.col("x"), 4).alias("x"), clean_zero(F.col("density"), 9).alias("density"))
)
query("mv_tstat", run_sql(f"select segment, count(*) n, round(avg(z), 3) + 0.0 mean, round(stddev_samp(z) / sqrt(count(*)), 3) + 0.0 sem, round(avg(z) / (stddev_samp(z) / sqrt(count(*))), 3) + 0.0 t from (select segment, outcome - 1000 z from res) group by segment"))(
    lambda s, d: rounded(mv.t_test(results(s, d).withColumn("z", F.col("outcome") - 1000), "z", ["segment"]), "mean", "sem", "t", digits=3)
)
#: Student's t with an odd number of degrees f has a closed form: P(|T| <= t) = 2 / pi (a + sin a (cos a + 2/3 cos^3 a + ..)), tan a = t / sqrt(f).
_WITHIN = "2 / pi() * (atan({t} / sqrt(f)) + case when f > 1 then sin(atan({t} / sqrt(f))) * list_sum(list_transform(range(0, cast((f - 1) / 2 as bigint)), lambda m: exp(list_sum(list_transform(range(0, m + 1), lambda q: case when q = 0 then 0.0 else ln(2.0 * q) - ln(2.0 * q + 1) end))) * pow(cos(atan({t} / sqrt(f))), 2 * m + 1))) else 0.0 end)"
_TESTS = {
    "te": "select segment, count(*) n, avg(z) mean, stddev_samp(z) / sqrt(count(*)) sem, count(*) - 1.0 f from (select segment, outcome - 1000 z from res) group by segment",
    "bi": f"select segment, n, mean, sem, f, 0.0::double lo, 64.0::double hi, 0 k from te union all select segment, n, mean, sem, f, case when {_WITHIN.format(t='((lo + hi) / 2)')} < 0.95 then (lo + hi) / 2 else lo end, case when {_WITHIN.format(t='((lo + hi) / 2)')} < 0.95 then hi else (lo + hi) / 2 end, k + 1 from bi where k < 50",
}
query("mv_tpvalues", run_sql(f"select segment, n, {r6('mean')} mean, {r6('sem')} sem, {r6('mean / sem')} t, {r6('1 - ' + _WITHIN.format(t='abs(mean / sem)'))} p, round(mean - lo * sem, 4) + 0.0 low, round(mean + lo * sem, 4) + 0.0 high from bi where k = 50", **_TESTS).replace("with ", "with recursive ", 1))(
    lambda s, d: rounded(rounded(mv.confidence_intervals(mv.t_p_values(mv.t_test(results(s, d).withColumn("z", F.col("outcome") - 1000), "z", ["segment"]))), "mean", "sem", "t", "p"), "low", "high", digits=4)
)
_RANK = {"rr": "select *, row_number() over (order by outcome, universe) rank from res"}
query("mv_speccurve", run_sql("select rank, universe, outcome, outcome > 1000 significant from rr", **_RANK))(lambda s, d: mv.specification_curve(results(s, d), "outcome", NAMES, F.col("outcome") > 1000)[0])
query("mv_specpanel", run_sql(" union all ".join(f"select rank, '{c}' decision, {c} as value from rr" for c in NAMES), **_RANK))(lambda s, d: mv.specification_curve(results(s, d), "outcome", NAMES)[1])
_BINS = {
    "bn": "select *, case when outcome <= min(outcome) over () then 0 else least(9, cast(ceil((outcome - min(outcome) over ()) / ((max(outcome) over () - min(outcome) over ()) / 10)) as integer) - 1) end bin from res",
    "tt": "select bin, count(*) n from bn group by bin",
    "hd": " union all ".join(f"select '{c}' decision, {c} as value, bin, count(*) k from bn group by all" for c in NAMES),
    "ev": "select * from (select distinct decision, value from hd) cross join (select cast(unnest(range(10)) as integer) bin)",
}
query("mv_heatmap", run_sql(f"select ev.decision, ev.value, ev.bin, {r6('coalesce(k, 0) / greatest(coalesce(n, 0), 1)')} share from ev left join hd using (decision, value, bin) left join tt on tt.bin = ev.bin", **_BINS))(lambda s, d: rounded(mv.outcome_bins(results(s, d), "outcome", NAMES), "share"))
query("mv_effects", run_sql(f"select decision, level as value, round(m, 4) + 0.0 mean, round(b, 4) + 0.0 difference from lv join ef using (decision, level)", **_MYH))(lambda s, d: rounded(mv.effects(results(s, d), "outcome", NAMES), "mean", "difference", digits=4))
query("mv_cube", run_sql("select status, agg, trim, round(avg(outcome), 4) + 0.0 mean, count(*) n from res group by cube (status, agg, trim)"))(lambda s, d: rounded(mv.effect_cube(results(s, d), "outcome", ["status", "agg", "trim"]), "mean", digits=4))
_KDE = {
    "st": "select min(outcome) lo, max(outcome) hi, stddev_samp(outcome) * pow(count(*), -0.2) h, count(*) n from res",
    "gr": "select cast(k as integer) k, lo + (hi - lo) * k / 99.0 x, h, n from st cross join (select unnest(range(100)) k)",
}
query("mv_kde", run_sql("select k, round(gr.x, 4) + 0.0 x, round(sum(exp(-((gr.x - outcome) / gr.h) * ((gr.x - outcome) / gr.h) / 2)) / any_value(gr.n * gr.h * sqrt(2 * pi())), 9) + 0.0 density from gr cross join res group by k, gr.x", **_KDE))(
    lambda s, d: mv.kde(results(s, d), "outcome", 100).select("k", (F.round("x", 4) + F.lit(0.0)).alias("x"), (F.round("density", 9) + F.lit(0.0)).alias("density"))
)
query("mv_tree", space_sql(" union all ".join(f"select {k + 1} as level, {('concat_ws(chr(47), ' + ', '.join(NAMES[:k]) + ')') if k else repr('')} parent, concat_ws('/', {', '.join(NAMES[:k + 1])}) node, count(*) n from sp group by all" for k in range(len(NAMES)))))(lambda s, d: mv.tree(space(s)))

# --- relational forms the analyses rest on ---

query("semi_join_mask", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")(
    lambda s, d: fx.read(s, d, "orders").join(fx.read(s, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")
)
query("anti_join_remove", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")(
    lambda s, d: fx.read(s, d, "customer").join(fx.read(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
)
query("topk_outliers", "select o_orderkey, o_totalprice from orders where o_totalprice < (select min(o_totalprice) from (select o_totalprice from orders order by o_totalprice desc limit 3))")(
    lambda s, d: fx.read(s, d, "orders").crossJoin(F.broadcast(fx.read(s, d, "orders").orderBy(F.desc("o_totalprice")).limit(3).agg(F.min("o_totalprice").alias("cut")))).filter("o_totalprice < cut").select("o_orderkey", "o_totalprice")
)
query("melt_decisions", "select o_orderkey, 'o_orderstatus' decision, o_orderstatus as value from orders union all select o_orderkey, 'o_orderpriority', o_orderpriority from orders")(
    lambda s, d: fx.read(s, d, "orders").unpivot(["o_orderkey"], ["o_orderstatus", "o_orderpriority"], "decision", "value")
)
