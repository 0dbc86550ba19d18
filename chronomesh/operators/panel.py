"""Panel operators: scaffolds, scaling, cleaning, parcellation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["subject", "t", "roi"]


def series() -> Window:
    return Window.partitionBy("subject", "roi")


def panel(df: DataFrame, t: str, roi: str, x: str, subject: str | None = None) -> DataFrame:
    """Name the columns of a long table; without a subject column all rows belong to subject 0."""
    who = F.col(subject).cast("long") if subject else F.lit(0).cast("long")
    return df.select(who.alias("subject"), F.col(t).cast("long").alias("t"), F.col(roi).alias("roi"), F.col(x).cast("double").alias("x"))


def scaffold(p: DataFrame, n_times: int, fill: float = 0.0) -> DataFrame:
    """Every (subject, t in 0..n_times - 1, roi) once; cells without a value get `fill`.

    The times are generated within the row of each (subject, roi), so no cross join is needed for them.
    """
    rois, subjects = p.select("roi").distinct(), p.select("subject").distinct()
    cells = subjects.crossJoin(rois).select("subject", "roi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_times - 1).cast("long"))).alias("t"))
    return cells.join(p, KEYS, "left").select(*KEYS, F.coalesce("x", F.lit(fill)).alias("x"))


def check_shapes(p: DataFrame) -> DataFrame:
    """(subject, times, rois, complete): whether each subject's panel is a full rectangle."""
    return p.groupBy("subject").agg(
        F.count_distinct("t").alias("times"), F.count_distinct("roi").alias("rois"), (F.count("x") == F.count_distinct("t") * F.count_distinct("roi")).alias("complete")
    )


def centred(p: DataFrame) -> DataFrame:
    """Series minus their means: changes no correlation, and keeps power sums from cancelling.

    What is left of a value that equals the mean but for rounding becomes zero, so a constant series stays constant.
    """
    mean = F.avg("x").over(series())
    left = F.col("x") - mean
    return p.withColumn("x", F.when(F.abs(left) <= F.abs(mean) * 1e-13, F.lit(0.0)).otherwise(left))


def standardise(p: DataFrame, ddof: int = 0) -> DataFrame:
    """Z-scores per series; a constant series becomes zeros."""
    sd = (F.stddev_pop("x") if ddof == 0 else F.stddev_samp("x")).over(series())
    return p.withColumn("x", (F.col("x") - F.avg("x").over(series())) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd))


def detrend(p: DataFrame) -> DataFrame:
    """Residuals of each series from its least-squares line over t."""
    t = F.col("t").cast("double")
    mt, mx = F.avg(t).over(series()), F.avg("x").over(series())
    slope = F.covar_pop(F.col("x"), t).over(series()) / F.when(F.var_pop(t).over(series()) == 0, F.lit(1.0)).otherwise(F.var_pop(t).over(series()))
    return p.withColumn("x", F.col("x") - mx - slope * (t - mt))


def discard_initial(p: DataFrame, n: int) -> DataFrame:
    """Drop the first n times and renumber the rest from 0."""
    return p.filter(F.col("t") >= n).withColumn("t", F.col("t") - n)


def global_signal(p: DataFrame) -> DataFrame:
    """(subject, t, g): the mean over regions."""
    return p.groupBy("subject", "t").agg(F.avg("x").alias("g"))


def regress_global_signal(p: DataFrame) -> DataFrame:
    """Residuals of each series from its own subject's global signal and a constant."""
    g = F.avg("x").over(Window.partitionBy("subject", "t"))
    with_g = p.withColumn("_g", g)
    mg, mx = F.avg("_g").over(series()), F.avg("x").over(series())
    var = F.var_pop("_g").over(series())
    slope = F.covar_pop("x", "_g").over(series()) / F.when(var == 0, F.lit(1.0)).otherwise(var)
    return with_g.withColumn("x", F.col("x") - mx - slope * (F.col("_g") - mg)).drop("_g")


def butterworth_sections(low: float | None, high: float | None, rate: float, order: int = 5) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital Butterworth filter by the bilinear transform.

    low: frequencies above it are removed; high: those below it; both: a band is kept.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if low and high:
        w1, w2 = warp(high), warp(low)
        scaled, centre = poles * (w2 - w1) / 2, np.sqrt(w1 * w2)
        root = np.sqrt(scaled**2 - centre**2 + 0j)
        p, z, gain = np.concatenate([scaled + root, scaled - root]), np.zeros(order), (w2 - w1) ** order
    elif low:
        p, z, gain = poles * warp(low), np.empty(0), warp(low) ** order
    else:
        p, z, gain = warp(high) / poles, np.zeros(order), 1.0
    k = gain * np.real(np.prod(2 * rate - z) / np.prod(2 * rate - p)) if len(z) else gain * np.real(1 / np.prod(2 * rate - p))
    dp = (2 * rate + p) / (2 * rate - p)
    dz = np.concatenate([(2 * rate + z) / (2 * rate - z), -np.ones(len(p) - len(z))])
    upper = [x for x in dp if x.imag > 1e-12]
    real = sorted(x.real for x in dp if abs(x.imag) <= 1e-12)
    pairs = [(x, x.conjugate()) for x in upper] + [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
    zeros = sorted(dz.real, key=lambda v: -v)
    out = []
    for m, (a, b) in enumerate(pairs):
        own = [zeros.pop(0 if m % 2 == 0 else -1) for _ in range(min(2, len(zeros)))] if len(zeros) > 1 else [zeros.pop()] if zeros else []
        num = np.poly(own) if own else np.ones(1)
        num = np.r_[num, np.zeros(3 - len(num))]
        out.append([*num, -(a + b).real, (a * b).real])
    sections = np.array(out)
    sections[0, :3] *= k
    return sections


def _run_sections(sections: np.ndarray, x: np.ndarray, settle: bool) -> np.ndarray:
    y = x.astype(float)
    for b0, b1, b2, a1, a2 in sections:
        z1 = z2 = 0.0
        if settle:  # the state at which a constant input of the first value passes unchanged
            g = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = (b2 - a2 * g) * y[0]
            z1 = (b1 - a1 * g) * y[0] + z2
        out = np.empty_like(y)
        for i, v in enumerate(y):
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            out[i] = o
        y = out
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward pass over a series, or over the columns of (times, series), with odd reflections at the ends."""
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    if pad < 1:
        return x.astype(float)
    long = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    there = _run_sections(sections, long, True)
    return _run_sections(sections, there[::-1], True)[::-1][pad:-pad]


def cosine_drifts(n: int, high_pass: float, t_r: float) -> np.ndarray:
    """(n, k): cosines of periods longer than 1 / high_pass seconds over n times."""
    k = min(n - 1, int(np.floor(2 * n * high_pass * t_r)))
    return np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * np.arange(1, k + 1) / n)


def clean(
    p: DataFrame,
    detrended: bool = False,
    confounds: DataFrame | None = None,
    standardised: bool = False,
    standardise_confounds: bool = True,
    low_pass: float | None = None,
    high_pass: float | None = None,
    t_r: float | None = None,
    ensure_finite: bool = False,
    filter_kind: str = "butterworth",
) -> DataFrame:
    """Signal cleaning: finite values, linear detrending, a filter, confound regression, z-scores.

    confounds: (subject, t, name, x). Detrending and z-scores stay in the engine; a filter or confounds make one
    kernel per subject, which holds that subject's series only. A filter needs t_r, the seconds between times.
    filter_kind: butterworth, or cosine, which regresses slow cosines below high_pass out with the confounds.
    """
    if filter_kind not in ("butterworth", "cosine"):
        raise ValueError(f"unknown filter {filter_kind}")
    if filter_kind == "cosine" and low_pass:
        raise ValueError("a cosine filter has no low_pass")
    if ensure_finite:
        p = p.withColumn("x", F.when(F.isnan("x") | F.col("x").isNull() | (F.abs("x") == float("inf")), F.lit(0.0)).otherwise(F.col("x")))
    if detrended:
        p = detrend(p)
    if confounds is None and not (low_pass or high_pass):
        return standardise(p) if standardised else p
    if (low_pass or high_pass) and not t_r:
        raise ValueError("a filter needs t_r")
    cosine = filter_kind == "cosine" and high_pass
    sections = butterworth_sections(low_pass, high_pass, 1.0 / t_r) if (low_pass or high_pass) and not cosine else None
    kind = p.schema["roi"].dataType.simpleString()

    def regress(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        if standardise_confounds:
            sd = c.std(0)
            c = (c - c.mean(0)) / np.where(sd == 0, 1, sd)
        design = np.column_stack([c, np.ones(len(c))])
        return x - design @ np.linalg.lstsq(design, x, rcond=None)[0]

    def kernel(panel_rows: pd.DataFrame, confound_rows: pd.DataFrame | None) -> pd.DataFrame:
        wide = panel_rows.pivot(index="t", columns="roi", values="x").sort_index()
        x = wide.to_numpy(float)
        c = None
        if confound_rows is not None and len(confound_rows):
            c = confound_rows.pivot(index="t", columns="name", values="x").reindex(wide.index).fillna(0.0).to_numpy(float)
            if detrended:
                line = np.column_stack([np.arange(len(c)), np.ones(len(c))])
                c = c - line @ np.linalg.lstsq(line, c, rcond=None)[0]
        if sections is not None:
            x = zero_phase(sections, x)
            if c is not None:
                c = zero_phase(sections, c)
        if cosine:
            slow = cosine_drifts(len(x), high_pass, t_r)
            c = slow if c is None else np.column_stack([c, slow])
        if c is not None and c.shape[1]:
            x = regress(x, c)
        out = pd.DataFrame(x, index=wide.index, columns=wide.columns).stack().rename("x").reset_index()
        out.insert(0, "subject", panel_rows["subject"].iloc[0])
        return out[["subject", "t", "roi", "x"]]

    schema = f"subject long, t long, roi {kind}, x double"
    if confounds is None:
        made = p.groupBy("subject").applyInPandas(lambda rows: kernel(rows, None), schema)
    else:
        made = p.groupBy("subject").cogroup(confounds.groupBy("subject")).applyInPandas(lambda a, b: kernel(a, b) if len(a) else pd.DataFrame(columns=["subject", "t", "roi", "x"]), schema)
    return standardise(made) if standardised else made


def confound_columns(names: list[str], strategy: list[str]) -> list[str]:
    """The confound columns that a list of strategies asks for, by their names' patterns; unknown ones are dropped."""
    starts = {
        "motion": ("trans_", "rot_"),
        "wm_csf": ("csf", "white_matter"),
        "global_signal": ("global_signal",),
        "compcor": ("a_comp_cor", "t_comp_cor"),
        "high_pass": ("cosine",),
        "ica_aroma": ("aroma_motion",),
        "scrub": ("motion_outlier", "non_steady_state"),
    }
    wanted = tuple(s for k in strategy for s in starts.get(k, ()))
    return [n for n in names if wanted and n.startswith(wanted)]


def kept_times(confounds: DataFrame, shortest: int = 5) -> DataFrame:
    """(subject, t) that scrubbing keeps: times that no `motion_outlier` or `non_steady_state` column of (subject, t, name, x)
    marks, but for stretches of fewer than `shortest` times between marked ones."""
    marks = F.max(F.when(F.col("name").rlike("^(motion_outlier|non_steady_state)"), F.abs("x")).otherwise(0.0)) > 0
    times = confounds.groupBy("subject", "t").agg(marks.alias("out"))
    before = F.sum(F.col("out").cast("int")).over(Window.partitionBy("subject").orderBy("t"))
    good = times.withColumn("stretch", before).filter("not out")
    length = F.count("*").over(Window.partitionBy("subject", "stretch"))
    return good.withColumn("length", length).filter(F.col("length") >= shortest).select("subject", "t")


def scrub(p: DataFrame, confounds: DataFrame, shortest: int = 5) -> DataFrame:
    """The panel without the times that kept_times() leaves out; times keep their numbers. Subjects without confounds lose all."""
    return p.join(kept_times(confounds, shortest), ["subject", "t"], "left_semi")


def demean(confounds: DataFrame) -> DataFrame:
    """Confounds (subject, t, name, x) less their means; missing values don't count."""
    return confounds.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("subject", "name")))


def parcellate(vertex_ts: DataFrame, atlas: DataFrame, parcels: DataFrame, standardised: bool = True, agg: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(subject, t, parcel, x): an aggregate of z-scored vertex values per parcel.

    vertex_ts: (subject, t, vertex, x); atlas: (vertex, parcel); parcels: (parcel). Parcel 0 is background. A parcel
    without vertices gives 0. The atlas has one row for each vertex of a fixed mesh, so Spark may broadcast it.
    """
    if standardised:
        sd = F.stddev_pop("x").over(Window.partitionBy("subject", "vertex"))
        mean = F.avg("x").over(Window.partitionBy("subject", "vertex"))
        vertex_ts = vertex_ts.withColumn("x", (F.col("x") - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))
    known = atlas.join(parcels.select("parcel"), "parcel")
    means = vertex_ts.join(known, "vertex").groupBy("subject", "t", "parcel").agg(agg(F.col("x")).alias("x"))
    cells = vertex_ts.select("subject", "t").distinct().crossJoin(parcels.select("parcel"))
    return cells.join(means, ["subject", "t", "parcel"], "left").select("subject", "t", "parcel", F.coalesce("x", F.lit(0.0)).alias("x"))


def vertex_values(parcel_values: DataFrame, atlas: DataFrame) -> DataFrame:
    """(vertex, value): each vertex with its parcel's value; null for background and parcels without one."""
    return atlas.join(parcel_values.select("parcel", "value"), "parcel", "left").select("vertex", "value")


def colour_limits(values: DataFrame) -> DataFrame:
    """(low, high, discrete): shared limits of the values, and whether they are at most 32 different integers."""
    n = F.count_distinct("value")
    whole = F.min((F.col("value") == F.floor("value")).cast("int")) == 1
    return values.agg(F.min("value").alias("low"), F.max("value").alias("high"), (whole & (n <= 32)).alias("discrete"))


def renumber(atlas: DataFrame, skip: int = 0, offset: int = 0) -> DataFrame:
    """(vertex, parcel): keys above `skip` renumbered 1.. in order, plus offset; others become 0."""
    keys = atlas.filter(F.col("parcel") > skip).select("parcel").distinct()
    ranked = keys.select("parcel", (F.row_number().over(Window.orderBy("parcel")) + offset).alias("to"))  # one row per parcel of an atlas
    return atlas.join(ranked, "parcel", "left").select("vertex", F.coalesce("to", F.lit(0)).cast("long").alias("parcel"))


def combined_atlas(cortex: DataFrame, subcortex: DataFrame) -> DataFrame:
    """(vertex, parcel) of two atlases over different vertices: subcortical parcels are numbered 1.. first, cortical ones follow.

    Parcel 0, the background of either, stays 0. A vertex that both atlases name raises an error.
    """
    below = subcortex.filter("parcel > 0").agg(F.count_distinct("parcel").alias("below"))  # one row
    upper = renumber(cortex).crossJoin(F.broadcast(below)).select("vertex", F.when(F.col("parcel") > 0, F.col("parcel") + F.col("below")).otherwise(0).cast("long").alias("parcel"))
    both = renumber(subcortex).unionByName(upper).groupBy("vertex").agg(F.count("*").alias("n"), F.max("parcel").alias("parcel"))
    return both.select("vertex", F.when(F.col("n") == 1, F.col("parcel")).otherwise(F.raise_error(F.lit("a vertex is in both atlases")).cast("long")).alias("parcel"))


def networks(labels: DataFrame) -> DataFrame:
    """(label, network, network_id) from parcel labels `..networks_HEMI_NETWORK_..`; `-lh`/`-rh` labels are Subcortical, id 0.

    Networks are numbered from 1 in alphabetical order. A label of any other form raises an error.
    """
    name = F.regexp_extract("label", r"networks_[A-Za-z]+_([A-Za-z]+)", 1)
    sub = F.col("label").rlike("-(lh|rh)$")
    found = labels.select("label", F.when(sub, F.lit("Subcortical")).when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("no network in label "), F.col("label")))).alias("network"))
    ids = found.filter("network <> 'Subcortical'").select("network").distinct().select("network", F.row_number().over(Window.orderBy("network")).cast("long").alias("network_id"))
    return found.join(ids, "network", "left").select("label", "network", F.coalesce("network_id", F.lit(0)).cast("long").alias("network_id"))


def segment_average(p: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, roi, x): mean over the times first_t..last_t of each segment (segment, first_t, last_t), ends included.

    The range join becomes an equi-join: each segment lists its own times.
    """
    times = segments.select("segment", F.explode(F.sequence("first_t", "last_t")).alias("t"))
    return p.join(times, "t").groupBy("segment", "roi").agg(F.avg("x").alias("x"))
