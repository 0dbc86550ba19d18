"""State-based connectivity and summaries of state sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.kernels import categorical_hmm, gaussian_hmm, kmeans
from chronomesh.functions.stats import ratio
from chronomesh.operators.dynamic import sliding_window



def in_order() -> Window:
    return Window.partitionBy("subject").orderBy("t")


# --- summaries: (subject, t, state) in, one row per subject and state out ---


def _scaffold(states: DataFrame, n_states: int | None) -> DataFrame:
    """(subject, state) for every state 0..K - 1; K is the largest state plus one unless given."""
    subjects = states.select("subject").distinct()
    if n_states is not None:
        return subjects.select("subject", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("state"))
    top = states.agg(F.max("state").alias("k"))  # one row
    return subjects.crossJoin(F.broadcast(top)).select("subject", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("state"))


def fractional_occupancy(states: DataFrame, n_states: int | None = None) -> DataFrame:
    """(subject, state, occupancy): share of times; 0 for states not visited."""
    n = states.groupBy("subject", "state").agg(F.count("*").alias("n"))
    share = n.withColumn("occupancy", F.col("n") / F.sum("n").over(Window.partitionBy("subject")))
    return _scaffold(states, n_states).join(share, ["subject", "state"], "left").select("subject", "state", F.coalesce("occupancy", F.lit(0.0)).alias("occupancy"))


def runs(states: DataFrame) -> DataFrame:
    """(subject, run, state, first_t, length): maximal stretches of one state."""
    new = F.when(F.lag("state").over(in_order()) == F.col("state"), 0).otherwise(1)
    numbered = states.withColumn("new", new).withColumn("run", F.sum("new").over(in_order()))
    return numbered.groupBy("subject", "run").agg(F.first("state").alias("state"), F.min("t").alias("first_t"), F.count("*").alias("length"))


def dwell_times(states: DataFrame, n_states: int | None = None) -> DataFrame:
    """(subject, state, dwell): mean length of a state's stretches; 0 if not visited."""
    mean = runs(states).groupBy("subject", "state").agg(F.avg("length").alias("dwell"))
    return _scaffold(states, n_states).join(mean, ["subject", "state"], "left").select("subject", "state", F.coalesce("dwell", F.lit(0.0)).alias("dwell"))


def transition_counts(states: DataFrame, n_states: int | None = None) -> DataFrame:
    """(subject, s_from, s_to, n): consecutive pairs, staying included; 0 for pairs that don't occur."""
    seen = states.withColumn("s_to", F.lead("state").over(in_order())).filter("s_to is not null").groupBy("subject", F.col("state").alias("s_from"), "s_to").agg(F.count("*").alias("n"))
    one = _scaffold(states, n_states)
    cells = one.withColumnRenamed("state", "s_from").join(one.withColumnRenamed("state", "s_to"), "subject")
    return cells.join(seen, ["subject", "s_from", "s_to"], "left").select("subject", "s_from", "s_to", F.coalesce("n", F.lit(0)).alias("n"))


def transition_matrix(states: DataFrame, n_states: int | None = None) -> DataFrame:
    """(subject, s_from, s_to, p): rows sum to 1; a state that is never left has a row of zeros."""
    total = F.sum("n").over(Window.partitionBy("subject", "s_from"))
    return transition_counts(states, n_states).select("subject", "s_from", "s_to", F.coalesce(ratio(F.col("n").cast("double"), total), F.lit(0.0)).alias("p"))


def switches(states: DataFrame) -> DataFrame:
    """(subject, switches, switch_rate): label changes, and changes per step."""
    changed = F.when(F.lag("state").over(in_order()) != F.col("state"), 1).otherwise(0)
    return states.withColumn("c", changed).groupBy("subject").agg(F.sum("c").alias("switches"), (F.sum("c") / F.greatest(F.count("*") - 1, F.lit(1))).alias("switch_rate"))


def summarise(states: DataFrame, n_states: int | None = None) -> dict[str, DataFrame]:
    """All summaries: by state, by transition, by subject."""
    return {
        "states": fractional_occupancy(states, n_states).join(dwell_times(states, n_states), ["subject", "state"]),
        "transitions": transition_counts(states, n_states).join(transition_matrix(states, n_states), ["subject", "s_from", "s_to"]),
        "subjects": switches(states),
    }


def group_means(summary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation over subjects."""
    return summary.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


# --- assignment and state matrices ---


def assign(features: DataFrame, centroids: DataFrame) -> DataFrame:
    """(subject, t, state, distance): nearest centroid of each (subject, t, f); centroids (state, c) are few by construction."""
    d = F.aggregate(F.zip_with("f", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    scored = features.crossJoin(F.broadcast(centroids)).select("subject", "t", F.struct(d.alias("d"), "state").alias("m"))
    return scored.groupBy("subject", "t").agg(F.min("m").alias("m")).select("subject", "t", F.col("m.state").alias("state"), F.sqrt("m.d").alias("distance"))


def inertia(features: DataFrame, centroids: DataFrame) -> DataFrame:
    """(inertia): summed squared distance to the nearest centroid."""
    return assign(features, centroids).agg(F.sum(F.col("distance") * F.col("distance")).alias("inertia"))


def outer_states(centroids: DataFrame) -> DataFrame:
    """(state, i, j, w): outer product of each centroid (state, c) over its places, i <= j."""
    made = "flatten(transform(c, (a, k) -> transform(slice(c, k + 1, size(c)), (b, m) -> struct(k as i, k + m as j, a * b as w))))"
    return centroids.select("state", F.expr(f"inline({made})"))


def rebuild_matrices(centroids: DataFrame, n: int, diagonal: float = 0.0) -> DataFrame:
    """(state, i, j, w): symmetric matrices from centroids (state, c) over the edges i < j of n regions, in order of (i, j)."""
    places = [(i, j) for i in range(n) for j in range(i + 1, n)]
    pair = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in places])
    half = centroids.select("state", F.posexplode(F.arrays_zip(pair.alias("p"), F.col("c").alias("w")))).select("state", "col.p.i", "col.p.j", "col.w")
    own = centroids.select("state", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("state", "i", F.col("i").alias("j"), F.lit(diagonal).alias("w"))
    return half.unionByName(half.select("state", F.col("j").alias("i"), F.col("i").alias("j"), "w")).unionByName(own)


def mean_matrices(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(state, i, j, w): mean of the edges over the times in each state."""
    return edges.join(states, ["subject", "t"]).groupBy("state", "i", "j").agg(F.avg("w").alias("w"))


def edge_features(edges: DataFrame) -> DataFrame:
    """(subject, t, f): each matrix's edges as an array in order of (i, j); null edges count as 0."""
    v = F.array_sort(F.collect_list(F.struct("i", "j", F.coalesce("w", F.lit(0.0)).alias("w"))))
    return edges.groupBy("subject", "t").agg(F.transform(v, lambda s: s["w"]).alias("f"))


def panel_features(p: DataFrame) -> DataFrame:
    """(subject, t, f): each time's regions as an array in order of region."""
    return p.groupBy("subject", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("roi", "x"))), lambda s: s["x"]).alias("f"))


def _subject_centroids(features: DataFrame, k: int, n_init: int, seed: int | None) -> DataFrame:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("t")["f"].to_list())
        c, _, _ = kmeans(x, min(k, len(x)), n_init, seed)
        return pd.DataFrame({"subject": rows["subject"].iloc[0], "f": list(c)})

    return features.groupBy("subject").applyInPandas(fit, "subject long, f array<double>")


def _group_centroids(rows: DataFrame, k: int, n_init: int, seed: int | None) -> DataFrame:
    """Centroids (state, c, inertia) of rows (f). Rows are subjects' centroids; one kernel clusters them in a task of its own."""

    def fit(found: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(found["f"].to_list())
        c, _, total = kmeans(x[np.lexsort(x.T[::-1])], k, n_init, seed)
        return pd.DataFrame({"state": range(len(c)), "c": list(c), "inertia": total})

    return rows.select("f", F.lit(0).alias("g")).groupBy("g").applyInPandas(fit, "state int, c array<double>, inertia double")


def _two_level(features: DataFrame, n_states: int, subject_clusters: int, n_init: int, seed: int | None, group_init: int = 50) -> tuple[DataFrame, DataFrame]:
    own = _subject_centroids(features, subject_clusters, n_init, seed)
    found = _group_centroids(own, n_states, group_init, seed).collect()  # n_states rows
    made = features.sparkSession.createDataFrame([(r.state, r.c, r.inertia) for r in found], "state int, c array<double>, inertia double")
    return assign(features, made.select("state", "c")).select("subject", "t", "state"), made


def two_level(features: DataFrame, n_states: int, subject_clusters: int, n_init: int = 50, seed: int | None = 0, group_init: int = 50) -> tuple[DataFrame, DataFrame]:
    """k-means within each subject, then over the subjects' centroids: (subject, t, state) and (state, c)."""
    labels, centroids = _two_level(features, n_states, subject_clusters, n_init, seed, group_init)
    return labels, centroids.select("state", "c")


def kmeans_cluster(edges: DataFrame, n_states: int = 5, strategy: str = "pooled", subject_clusters: int = 5, standardised: bool = False, n_init: int = 50, seed: int | None = 0) -> dict[str, DataFrame]:
    """k-means states of any time-resolved connectivity: state_tc, centroids, inertia.

    pooled: Spark's distributed k-means over all rows, best of n_init seeds; two_level: subject kernels, then one
    over their centroids. inertia is that of the last clustering: of all rows, or of the subjects' centroids.
    """
    features = edge_features(edges)
    if standardised:
        rows = features.select("subject", "t", F.posexplode("f").alias("k", "x"))
        whole = Window.partitionBy("k")
        rows = rows.withColumn("x", (F.col("x") - F.avg("x").over(whole)) / (F.stddev_pop("x").over(whole) + 1e-8))
        features = rows.groupBy("subject", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("f"))
    if strategy == "two_level":
        labels, centroids = _two_level(features, n_states, subject_clusters, n_init, seed)
        total, centroids = centroids.agg(F.max("inertia").alias("inertia")), centroids.select("state", "c")
    elif strategy == "pooled":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        vectors = features.withColumn("features", array_to_vector("f")).cache()
        fits = [KMeans(k=n_states, seed=(seed or 0) + s, maxIter=100, tol=1e-9).fit(vectors) for s in range(n_init)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        centres = sorted(c.tolist() for c in best.clusterCenters())
        vectors.unpersist()
        centroids = edges.sparkSession.createDataFrame(list(enumerate(centres)), "state int, c array<double>")
        labels, total = assign(features, centroids).select("subject", "t", "state"), inertia(features, centroids)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return {"state_tc": labels, "centroids": centroids, "inertia": total}


def sliding_window_clustering(p: DataFrame, n_states: int = 5, subject_clusters: int = 5, size: int = 29, step: int = 15, shape: str = "gaussian", std: float = 10.0, n_init: int = 50, seed: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """Two-level k-means of sliding-window matrices: (subject, t, state) and centroids (state, c)."""
    return two_level(edge_features(sliding_window(p, size, step, shape, std)), n_states, subject_clusters, n_init, seed)


def coactivation_patterns(p: DataFrame, n_states: int = 5, subject_clusters: int = 5, n_init: int = 50, seed: int | None = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two-level k-means of the panel's rows: (subject, t, state), centroids, and their outer products as state matrices."""
    labels, centroids = two_level(panel_features(p), n_states, subject_clusters, n_init, seed)
    return labels, centroids, outer_states(centroids)


def encode_atoms(features: DataFrame, atoms: DataFrame) -> DataFrame:
    """(subject, t, state, weight): the atom (state, c) of a dictionary that best fits each (subject, t, f), with one coefficient.

    Atoms have unit length and are few by construction. Ties go to the smaller state.
    """
    dot = F.aggregate(F.zip_with("f", "c", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = features.crossJoin(F.broadcast(atoms)).select("subject", "t", F.struct((-F.abs(dot)).alias("least"), "state", dot.alias("weight")).alias("m"))
    return scored.groupBy("subject", "t").agg(F.min("m").alias("m")).select("subject", "t", F.col("m.state").alias("state"), F.col("m.weight").alias("weight"))


def dictionary(features: DataFrame, n_states: int = 5, rounds: int = 20, seed: int = 0) -> DataFrame:
    """Atoms (state, c) of a dictionary learned over all rows (subject, t, f) of all subjects by approximate K-SVD, one coefficient a row.

    Each round, the rows that an atom fits best are summed with their coefficients where they lie; n_states sums come to the driver.
    """
    features = features.select("f").persist()
    first = features.first()
    rng = np.random.default_rng(seed)
    atoms = rng.standard_normal((n_states, len(first.f) if first else 0))
    atoms /= np.maximum(np.linalg.norm(atoms, axis=1, keepdims=True), 1e-300)
    for _ in range(rounds if first else 0):

        def partial(batches, atoms=atoms):
            total = np.zeros_like(atoms)
            for rows in batches:
                if len(rows):
                    x = np.stack(rows["f"].to_list())
                    dots = x @ atoms.T
                    best = np.abs(dots).argmax(1)
                    np.add.at(total, best, dots[np.arange(len(best)), best][:, None] * x)
            yield pd.DataFrame({"state": range(len(atoms)), "v": list(total)})

        sums = features.mapInPandas(partial, "state int, v array<double>").select("state", F.posexplode("v").alias("k", "v")).groupBy("state", "k").agg(F.sum("v").alias("v")).collect()
        step = np.zeros_like(atoms)
        for r in sums:
            step[r.state, r.k] = r.v
        norm = np.linalg.norm(step, axis=1, keepdims=True)
        atoms = np.where(norm > 0, step / np.where(norm > 0, norm, 1.0), atoms)
    features.unpersist()
    if first:
        atoms = atoms * np.where(atoms[np.arange(n_states), np.abs(atoms).argmax(1)] < 0, -1.0, 1.0)[:, None]
        atoms = atoms[np.lexsort(atoms.T[::-1])]
    return features.sparkSession.createDataFrame([(k, a.tolist()) for k, a in enumerate(atoms)] if first else [], "state int, c array<double>")


def ksvd_states(p: DataFrame, n_states: int = 5, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K-SVD states of all subjects together: (subject, t, state, weight), atoms (state, c), and their outer products as state matrices."""
    features = panel_features(p)
    atoms = dictionary(features, n_states, rounds, seed)
    return encode_atoms(features, atoms), atoms, outer_states(atoms)


def _best_restart(features: DataFrame, fits: int, one, schema: str, respect_subjects: bool) -> DataFrame:
    """Independent restarts in parallel: each (group, seed) is one kernel; the best score of a group wins."""
    group = F.col("subject") if respect_subjects else F.lit(0).cast("long")
    tried = features.withColumn("g", group).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(fits - 1))))
    made = tried.groupBy("g", "seed").applyInPandas(one, schema)
    best = made.groupBy("g").agg(F.max_by("seed", F.struct("score", -F.col("seed"))).alias("seed"))
    return made.join(best, ["g", "seed"])


def _gaussian_rows(rows: pd.DataFrame, n_states: int) -> tuple[pd.DataFrame, dict, np.ndarray]:
    rows = rows.sort_values(["subject", "t"])
    m = gaussian_hmm(np.stack(rows["f"].to_list()), n_states, int(rows["seed"].iloc[0]))
    return rows, m, np.lexsort(m["means"].T[::-1])


def gaussian_hmm_states(p: DataFrame, n_states: int = 5, restarts: int = 20, respect_subjects: bool = False) -> DataFrame:
    """(subject, t, state, score): Viterbi labels of a Gaussian HMM with full covariances, best of several restarts.

    Without respect_subjects all subjects' rows make one sequence in order of subject, in one kernel per restart.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows, m, order = _gaussian_rows(rows, n_states)
        return rows[["g", "seed", "subject", "t"]].assign(state=np.argsort(order)[m["labels"]], score=m["score"])

    return _best_restart(panel_features(p), restarts, one, "g long, seed int, subject long, t long, state int, score double", respect_subjects).select("subject", "t", "state", "score")


def gaussian_hmm_matrices(p: DataFrame, n_states: int = 5, restarts: int = 20) -> DataFrame:
    """(state, i, j, w): the states' covariances, i <= j as places of regions, of the fit that gaussian_hmm_states() takes without respect_subjects."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows, m, order = _gaussian_rows(rows, n_states)
        covs = m["covs"][order]
        a, b = np.triu_indices(covs.shape[1])
        return pd.DataFrame({"g": 0, "seed": rows["seed"].iloc[0], "state": np.repeat(np.arange(len(covs)), len(a)), "i": np.tile(a, len(covs)), "j": np.tile(b, len(covs)), "w": covs[:, a, b].ravel(), "score": m["score"]})

    return _best_restart(panel_features(p), restarts, one, "g long, seed int, state int, i int, j int, w double, score double", False).select("state", "i", "j", "w")


def discrete_hmm_states(p: DataFrame, n_states: int = 5, state_ratio: float = 0.6, subject_clusters: int = 5, size: int = 29, step: int = 15, shape: str = "gaussian", std: float = 10.0, restarts: int = 20, n_init: int = 50, seed: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """Categorical HMM over the labels of sliding_window_clustering: (subject, t, state) and mean matrices (state, i, j, w).

    A state that is never visited has no matrix.
    """
    edges = sliding_window(p, size, step, shape, std)
    observed = max(2, int(n_states * state_ratio))
    labels, _ = two_level(edge_features(edges), observed, subject_clusters, n_init, seed)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["subject", "t"])
        m = categorical_hmm(rows["state"].to_numpy(int), observed, n_states, int(rows["seed"].iloc[0]))
        return rows[["g", "seed", "subject", "t"]].assign(state=m["labels"], score=m["score"])

    found = _best_restart(labels, restarts, one, "g long, seed int, subject long, t long, state int, score double", False).select("subject", "t", "state")
    return found, mean_matrices(edges, found)
