"""Operators against their definitions in NumPy, hand-computed values and identities."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronomesh.functions import kernels, special
from chronomesh.functions.stats import exact_medians
from chronomesh.operators import dynamic, edges, panel, phase, recursive, states, static, wavelet
from chronomesh.operators import graph_measures as gm
from chronomesh.operators import graph_paths as gp
from chronomesh.operators import graph_prep as prep
from chronomesh.sources.readers import array_panel

RNG = np.random.default_rng(7)
X = RNG.standard_normal((40, 4)).cumsum(0) * 0.3 + RNG.standard_normal((40, 4))


@pytest.fixture(scope="module")
def p(spark):
    return array_panel(spark, X).cache()


def cube(df, value="w"):
    return {(r.subject, r.t, r.i, r.j): r[value] for r in df.collect()}


# --- connectivity ---


def test_pearson_and_partial(p):
    expect, inv = np.corrcoef(X.T), np.linalg.inv(np.cov(X.T))
    for r in static.pearson(p).collect():
        assert math.isclose(r.w, expect[r.i, r.j], abs_tol=1e-9)
    for r in static.partial(p).collect():
        assert math.isclose(r.w, -inv[r.i, r.j] / math.sqrt(inv[r.i, r.i] * inv[r.j, r.j]), abs_tol=1e-9)
    for r in static.pearson(p, fisher=True).collect():
        assert math.isclose(r.w, math.atanh(expect[r.i, r.j]), abs_tol=1e-9)


def test_constant_series_gives_null(spark):
    data = X[:10, :3].copy()
    data[:, 1] = 2.0
    got = {(r.i, r.j): r.w for r in static.pearson(array_panel(spark, data)).collect()}
    assert got[0, 1] is None and got[1, 2] is None and got[0, 2] is not None


def test_mutual_information_bins(spark):
    data = np.array([[0, 0], [5, 1], [9.99, 2], [10, 3]], float)
    b = np.array([1, 6, 10, 11])  # the largest value has a bin of its own
    got = static.mutual_information(array_panel(spark, data)).first().w
    assert len(set(b)) == 4 and math.isclose(got, math.log(4), abs_tol=1e-9)


def test_sliding_window_and_jackknife(p):
    k = np.arange(11)
    for shape, w in {"rectangular": np.ones(11), "gaussian": np.exp(-0.5 * ((k - 5) / 3) ** 2), "hamming": 0.54 - 0.46 * np.cos(2 * np.pi * k / 10)}.items():
        got = cube(dynamic.sliding_window(p, 11, 3, shape, 3.0))
        assert {t for _, t, _, _ in got} == set(range(10))
        for (_, t, i, j), v in got.items():
            x = X[3 * t : 3 * t + 11]
            c = np.cov(x.T, aweights=w, ddof=0)
            assert math.isclose(v, c[i, j] / math.sqrt(c[i, i] * c[j, j]), abs_tol=1e-9)
    for (_, t, i, j), v in cube(dynamic.jackknife(p, 3)).items():
        rest = np.delete(X, slice(t, t + 3), 0)
        assert math.isclose(v, -np.corrcoef(rest.T)[i, j], abs_tol=1e-9)


def test_temporal_derivatives(p):
    d = np.diff(X, axis=0)
    d = d / d.std(0)
    got = cube(dynamic.temporal_derivatives(p, 7))
    assert {t for _, t, _, _ in got} == set(range(33))
    for (_, t, i, j), v in got.items():
        assert math.isclose(v, (d[t : t + 7, i] * d[t : t + 7, j]).mean(), abs_tol=1e-9)


def test_phase_and_leida(spark):
    for n in (16, 17):
        x = RNG.standard_normal((n, 4))
        kernel = np.array([(2 / n) * sum(math.sin(2 * math.pi * m * d / n) for m in range(1, ((n - 1) // 2 if n % 2 else n // 2 - 1) + 1)) for d in range(n)])
        h = np.array([[sum(x[s, c] * kernel[(t - s) % n] for s in range(n)) for c in range(4)] for t in range(n)])
        phi = np.arctan2(h, x)
        df = array_panel(spark, x)
        for r in phase.analytic_phase(df).collect():
            assert math.isclose(r.phase, phi[r.t, r.roi], abs_tol=1e-9)
        for (_, t, i, j), v in cube(phase.leida(df)).items():
            vec = np.linalg.eigh(np.cos(phi[t][:, None] - phi[t]))[1][:, -1]
            assert math.isclose(v, vec[i] * vec[j], abs_tol=1e-9)


def test_edge_connectivity(p):
    z = (X - X.mean(0)) / X.std(0, ddof=1)
    series = edges.edge_series(p)
    for r in edges.edge_connectivity(series).collect():
        a, b = z[:, r.i1] * z[:, r.j1], z[:, r.i2] * z[:, r.j2]
        assert math.isclose(r.w, a @ b / math.sqrt((a @ a) * (b @ b)), abs_tol=1e-9)


def test_fls_equals_dense_solution():
    x, mu = RNG.standard_normal((12, 3)), 10.0
    got = recursive.fls_paths(x, mu)
    for i in range(3):
        a = np.diag(x[:, i] ** 2 + np.where(np.isin(np.arange(12), (0, 11)), mu, 2 * mu)) - mu * (np.eye(12, k=1) + np.eye(12, k=-1))
        for j in range(3):
            assert np.allclose(got[:, i, j], np.linalg.solve(a, x[:, i] * x[:, j]))


def test_dcc_recovers_correlation(spark):
    a = RNG.standard_normal((300, 1))
    x = np.hstack([a + 0.5 * RNG.standard_normal((300, 1)), a + 0.5 * RNG.standard_normal((300, 1)), RNG.standard_normal((300, 1))])
    got = cube(recursive.dynamic_conditional_correlation(array_panel(spark, x)))
    mean = lambda i, j: np.mean([v for (_, _, a_, b_), v in got.items() if (a_, b_) == (i, j)])
    assert mean(0, 1) > 0.7 and abs(mean(0, 2)) < 0.25


def test_dcc_times(spark):
    """R_t holds the residuals of t, as computed by hand for two series; the likelihood's correlations don't."""
    eps, r, a, b = np.array([[1.0, 2.0], [-1.0, 0.5]]), 0.5, 0.1, 0.6
    s = np.array([[1.0, r], [r, 1.0]])
    q0 = np.array([[0.3 + 0.1 * 1 + 0.6, 0.5 * 0.3 + 0.1 * 2 + 0.6 * 0.5], [0, 0.3 + 0.1 * 4 + 0.6]])
    first = q0[0, 1] / math.sqrt(q0[0, 0] * q0[1, 1])
    q1 = [0.3 + 0.1 * q0[0, 0] + 0.6 * q0[0, 0], 0.5 * 0.3 - 0.1 * 0.5 * math.sqrt(q0[0, 0] * q0[1, 1]) + 0.6 * q0[0, 1], 0.3 + 0.1 * 0.25 * q0[1, 1] + 0.6 * q0[1, 1]]
    got = recursive.dcc_recursion(eps, s, a, b)
    assert np.allclose(got[:, 0, 1], [first, q1[1] / math.sqrt(q1[0] * q1[2])]) and np.allclose(got[:, 0, 0], 1)
    assert np.allclose(recursive.dcc_forecasts(eps, s, a, b)[:, 0, 1], [0.5, first])


def test_dcc_parameters(spark):
    x = RNG.standard_normal((80, 3)) * (1 + np.abs(np.sin(np.arange(80) / 9)))[:, None]
    residuals = recursive.garch_residuals(array_panel(spark, x))
    theta = {r.roi: (r.omega, r.alpha, r.beta) for r in recursive.garch_parameters(residuals).collect()}
    assert len(theta) == 3 and all(min(v) >= 0 and v[1] + v[2] < 1 for v in theta.values())
    for r in residuals.filter("t = 1").collect():
        own = x[:, r.roi] - x[:, r.roi].mean()
        assert math.isclose(r.sd**2, theta[r.roi][0] + theta[r.roi][1] * own[0] ** 2 + theta[r.roi][2] * np.mean(own**2), rel_tol=1e-9)
    ab = recursive.dcc_parameters(residuals).first()
    assert ab.a >= 0 and ab.b >= 0 and ab.a + ab.b < 1
    free, fixed = (cube(recursive.dynamic_conditional_correlation(array_panel(spark, x), t)) for t in (None, (ab.a, ab.b)))
    assert all(math.isclose(free[k], fixed[k], abs_tol=1e-9) for k in free)


def test_wavelet_smoothing_over_scales():
    _, step = wavelet.scales(0.007, 0.15, 15)
    assert np.allclose(wavelet.scale_window(step), np.array([1, 2, 2, 1]) / 6)
    assert np.allclose(wavelet.scale_window(0.6), [0.5, 0.5]) and np.allclose(wavelet.scale_window(0.4), [0.25, 0.5, 0.25]) and np.allclose(wavelet.scale_window(5), [1])
    w = np.zeros((8, 64))
    w[4] = 1.0  # constant in time: only neighbouring scales see it
    for step in (0.316, 0.4, 5.0):
        made, box = wavelet.smooth(w, 1.0, np.full(8, 2.0), step)[:, 30], wavelet.scale_window(step)
        assert np.allclose(made, np.convolve(w[:, 30], box)[(len(box) - 1) // 2 :][:8])


def test_coherence_by_scale(spark):
    x = RNG.standard_normal((120, 2))
    rows = wavelet.coherence_by_scale(array_panel(spark, np.column_stack([x, x[:, 0]])), 1.0, 0.05, 0.4, 6).collect()
    assert len(rows) == 3 * 6 * 120 and all(0 <= r.c <= 1 for r in rows)
    assert all(math.isclose(r.c, 1, abs_tol=1e-6) for r in rows if (r.i, r.j) == (0, 2))


def test_wavelet_coherence_of_equal_series():
    s, step = wavelet.scales(0.01, 0.15, 12)
    w = wavelet.transform(RNG.standard_normal(256), 1.0, s)
    c, _ = wavelet.coherence(w, w, 1.0, s, step)
    assert np.allclose(c, 1, atol=1e-6)


def test_butterworth():
    for low, high in ((0.1, None), (None, 0.05), (0.1, 0.02)):
        sections = panel.butterworth_sections(low, high, 1.0)
        f = np.linspace(0.001, 0.499, 400)
        z = np.exp(2j * np.pi * f)
        h = np.abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in sections], axis=0))
        at = lambda q: h[np.abs(f - q).argmin()]
        if low:
            assert abs(at(low) - 2**-0.5) < 0.03 and at(0.4) < 0.01
        if high:
            assert abs(at(high) - 2**-0.5) < 0.06 and at(0.003) < 0.01
        assert h.max() < 1.0001


def test_filters_run_over_columns_at_once():
    sections, x = panel.butterworth_sections(0.2, 0.02, 1.0), RNG.standard_normal((90, 5))
    assert np.allclose(panel.zero_phase(sections, x), np.column_stack([panel.zero_phase(sections, x[:, k]) for k in range(5)]), atol=1e-12)
    assert panel.zero_phase(sections, x[:1]).shape == (1, 5)


def test_panel_cleaning(spark, p):
    t = np.arange(40)
    flat = {(r.t, r.roi): r.x for r in panel.detrend(p).collect()}
    for k in range(4):
        line = np.polyval(np.polyfit(t, X[:, k], 1), t)
        assert all(math.isclose(flat[i, k], X[i, k] - line[i], abs_tol=1e-9) for i in range(40))
    kept = panel.clean(p, detrended=True, low_pass=0.2, high_pass=0.02, t_r=1.0, standardised=True)
    sd = {r.roi: r.s for r in kept.groupBy("roi").agg(F.stddev_pop("x").alias("s")).collect()}
    assert all(math.isclose(v, 1.0, abs_tol=1e-9) for v in sd.values())
    with pytest.raises(ValueError):
        panel.clean(p, low_pass=0.1)
    assert panel.confound_columns(["trans_x", "rot_z", "csf", "cosine01", "age"], ["motion", "high_pass", "nothing"]) == ["trans_x", "rot_z", "cosine01"]


def test_cosine_filter(spark):
    n = np.arange(100)
    slow, fast = np.cos(np.pi * (n + 0.5) * 2 / 100), np.sin(2 * np.pi * n / 10)
    df = array_panel(spark, np.column_stack([slow + fast, fast]))
    got = {(r.t, r.roi): r.x for r in panel.clean(df, high_pass=0.03, t_r=1.0, filter_kind="cosine").collect()}
    assert panel.cosine_drifts(100, 0.03, 1.0).shape == (100, 6)
    design = np.column_stack([np.cos(np.pi * (n[:, None] + 0.5) * np.arange(7) / 100)])  # the constant too
    left = fast - design @ np.linalg.lstsq(design, fast, rcond=None)[0]
    assert all(abs(got[t, k] - left[t]) < 1e-9 for t in range(100) for k in (0, 1))
    with pytest.raises(ValueError):
        panel.clean(df, low_pass=0.1, t_r=1.0, filter_kind="cosine")


# --- states ---

GOLDEN = {0: ([0] * 70 + [1] * 30, [70, 30], [0.7, 0.3], 1), 1: ([0] * 50 + [1] * 50, [50, 50], [0.5, 0.5], 1), 2: ([1] * 20 + [0] * 30 + [1] * 50, [30, 35], [0.3, 0.7], 2)}
COUNTS = {0: [[69, 1], [0, 29]], 1: [[49, 1], [0, 49]], 2: [[29, 1], [1, 68]]}


def test_state_summary(spark):
    rows = [(s, t, k) for s, (labels, *_) in GOLDEN.items() for t, k in enumerate(labels)]
    got = states.summarise(spark.createDataFrame(rows, "subject long, t long, state int"))
    for r in got["states"].collect():
        assert math.isclose(r.dwell, GOLDEN[r.subject][1][r.state]) and math.isclose(r.occupancy, GOLDEN[r.subject][2][r.state])
    for r in got["transitions"].collect():
        row = COUNTS[r.subject][r.s_from]
        assert r.n == row[r.s_to] and math.isclose(r.p, row[r.s_to] / sum(row))
    assert all(r.switches == GOLDEN[r.subject][3] and math.isclose(r.switch_rate, r.switches / 99) for r in got["subjects"].collect())


def test_states_find_planted_clusters(spark):
    rng = np.random.default_rng(1)
    labels = np.repeat([0, 1, 0, 1], 25)
    x = np.stack([np.array([[3, 0, 0], [0, 3, -3]])[labels] + 0.2 * rng.standard_normal((100, 3)) for _ in range(3)])
    df = array_panel(spark, x)
    for found in (states.coactivation_patterns(df, 2, 2, n_init=3)[0], states.gaussian_hmm_states(df, 2, 2), states.ksvd_states(df, 2)[0]):
        got = {(r.subject, r.t): r.state for r in found.collect()}
        same = np.mean([got[s, t] == labels[t] for s, t in got])
        assert max(same, 1 - same) > 0.97 and len(got) == 300


def test_dictionary_is_pooled_over_subjects(spark):
    """Subjects that see one pattern each share a dictionary: equal states mean equal patterns."""
    rng = np.random.default_rng(2)
    a, b = np.array([3.0, 0, 1]), np.array([0, -2.0, 2])
    shown = [[a] * 40, [b] * 40, [a] * 20 + [b] * 20]
    x = np.stack([np.array(rows) * rng.choice([-1, 1], (40, 1)) + 0.05 * rng.standard_normal((40, 3)) for rows in shown])
    found, atoms, matrices = states.ksvd_states(array_panel(spark, x), 2)
    got = {(r.subject, r.t): (r.state, r.weight) for r in found.collect()}
    first = {got[0, t][0] for t in range(40)}
    assert len(first) == 1 and {got[1, t][0] for t in range(40)} == {0, 1} - first
    assert {got[2, t][0] for t in range(20)} == first and not {got[2, t][0] for t in range(20, 40)} & first
    learned = {r.state: np.array(r.c) for r in atoms.collect()}
    k = first.pop()
    assert abs(abs(learned[k] @ a) / np.linalg.norm(a) - 1) < 1e-3 and abs(abs(learned[1 - k] @ b) / np.linalg.norm(b) - 1) < 1e-3
    assert all(math.isclose(w, learned[z] @ x[s, t], abs_tol=1e-9) for (s, t), (z, w) in got.items())
    assert all(math.isclose(r.w, learned[r.state][r.i] * learned[r.state][r.j]) for r in matrices.collect())


def test_two_level_inertia_is_that_of_the_centroids(spark):
    rng = np.random.default_rng(3)
    x = np.stack([np.repeat([[0.9, 0.1, 0.2], [0.1, 0.8, -0.3]], 15, axis=0) + 0.1 * rng.standard_normal((30, 3)) for _ in range(3)])
    rows = [(s, t, i, j, float(x[s, t, k])) for s in range(3) for t in range(30) for k, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)])]
    df = spark.createDataFrame(rows, "subject long, t long, i long, j long, w double")
    got = states.kmeans_cluster(df, 2, "two_level", 2, n_init=4)
    own = np.vstack([kernels.kmeans(x[s], 2, 4, 0)[0] for s in range(3)])
    centres = np.array([r.c for r in got["centroids"].orderBy("state").collect()])
    expect = ((own[:, None] - centres[None]) ** 2).sum(2).min(1).sum()
    assert math.isclose(got["inertia"].first().inertia, expect, rel_tol=1e-9)
    pooled = states.kmeans_cluster(df, 2, n_init=2)
    centres, flat = np.array([r.c for r in pooled["centroids"].collect()]), x.reshape(-1, 3)
    assert math.isclose(pooled["inertia"].first().inertia, ((flat[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), rel_tol=1e-9)


def test_hmm_covariances(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.multivariate_normal([4, 0], [[1, 0.8], [0.8, 1]], 150), rng.multivariate_normal([-4, 0], [[1, -0.5], [-0.5, 1]], 150)])
    got = {(r.state, r.i, r.j): r.w for r in states.gaussian_hmm_matrices(array_panel(spark, x), 2, 2).collect()}
    assert len(got) == 6 and abs(got[0, 0, 1] + 0.5) < 0.2 and abs(got[1, 0, 1] - 0.8) < 0.2 and abs(got[0, 0, 0] - 1) < 0.3


def test_exact_medians(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=5001), "b": rng.integers(0, 3, 4000).astype(float), "c": np.array([7.0]), "d": np.array([1.0, 2.0]), "e": np.full(999, 5.0), "f": np.r_[np.zeros(500), np.ones(500)]}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("none", None)]
    got = {r.k: r.median for r in exact_medians(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert got == {k: float(np.median(x)) for k, x in groups.items()}


def test_kmeans_is_seeded():
    x = np.vstack([RNG.normal(c, 0.1, (30, 2)) for c in (0, 3, 6)])
    a, b = kernels.kmeans(x, 3, 5, 1), kernels.kmeans(x, 3, 5, 1)
    assert np.allclose(a[0], b[0]) and np.allclose(a[0][:, 0], [0, 3, 6], atol=0.1)


# --- graphs ---


def random_graph(n=12, density=0.5, seed=3):
    rng = np.random.default_rng(seed)
    m = np.triu(rng.random((n, n)) * (rng.random((n, n)) < density), 1)
    return m + m.T


M = random_graph()


@pytest.fixture(scope="module")
def g(spark):
    return prep.from_matrix(M, spark)


def test_threshold_density_counts_all_pairs(spark):
    m = np.zeros((5, 5))
    for k, (i, j) in enumerate([(0, 1), (0, 2), (1, 2), (3, 4)]):
        m[i, j] = m[j, i] = [0.5, 0.5, -0.2, 0.9][k]
    graph = prep.from_matrix(m, spark)
    got = lambda d: {(r.i, r.j) for r in prep.threshold_density(graph, d).collect()}
    assert got(0.25) == {(3, 4), (0, 2), (0, 1)}  # 2.5 pairs round up to 3
    assert got(0.2) == {(3, 4), (0, 2)}  # of equal weights the larger pair first
    assert got(0.9) == {(3, 4), (0, 2), (0, 1)} and got(1.0) == {(3, 4), (0, 2), (0, 1), (1, 2)}
    with pytest.raises(ValueError):
        prep.threshold_density(graph, 1.5)


def naive_lengths(m):
    d = np.where(m != 0, m, np.inf)
    np.fill_diagonal(d, 0)
    for _ in range(len(m)):
        d = np.min(d[:, :, None] + d[None], axis=1)
    return d


def test_paths():
    assert np.allclose(gp.lengths(M), naive_lengths(M)) and np.array_equal(gp.hops(M), naive_lengths((M != 0).astype(float)))
    split = np.zeros((4, 4))
    split[0, 1] = split[1, 0] = 1
    assert np.isinf(gp.hops(split)[0, 2]) and gp.mean_path(split) == 1.0 and math.isinf(gp.mean_path(split, infinite=True))
    assert math.isclose(gp.global_efficiency(split), 2 / 12)


def test_betweenness_counts_all_shortest_paths():
    ring = np.roll(np.eye(6), 1, 1) + np.roll(np.eye(6), -1, 1)
    assert np.allclose(gp.betweenness(ring), 4.0)
    star = np.zeros((5, 5))
    star[0, 1:] = star[1:, 0] = 1
    assert np.allclose(gp.betweenness(star), [12, 0, 0, 0, 0]) and np.allclose(gp.betweenness(star * 2, True), [12, 0, 0, 0, 0])


def test_local_efficiency_of_complete_graph():
    full = np.ones((5, 5)) - np.eye(5)
    assert np.allclose(gp.local_efficiency(full), 1.0) and np.allclose(gp.local_efficiency(np.eye(3)[::-1] * 0), 0)


def test_triangles_and_clustering(g):
    root, k = np.cbrt(M), (M != 0).sum(1)
    cyc = np.diag(root @ root @ root)
    got = {r.i: r.clustering for r in gm.clustering(g, True).collect()}
    assert all(math.isclose(got[i], cyc[i] / (k[i] * (k[i] - 1)) if k[i] > 1 else 0, abs_tol=1e-9) for i in range(len(M)))
    assert math.isclose(gm.transitivity(g, True).first().transitivity, gp.transitivity_of(M), abs_tol=1e-9)
    assert math.isclose(gm.onnela(g).first().clustering, gp.onnela_of(M), abs_tol=1e-9)


def test_randomise_keeps_weights(g):
    got = prep.randomise(g, 5).collect()
    assert sorted(round(r.w, 9) for r in got) == sorted(np.round(M[np.triu_indices(12, 1)][M[np.triu_indices(12, 1)] > 0], 9))
    assert {(r.i, r.j) for r in got} != {(r.i, r.j) for r in g.edges.collect()}


def test_backbone_is_a_spanning_tree():
    tree = gp.backbone(M)
    assert (tree != 0).sum() == 2 * 11 and np.isfinite(gp.hops(tree)).all()
    assert (gp.backbone(M, 4.0) != 0).sum() == 48


def test_centralities_and_modules():
    r = gp.pagerank(M)
    assert math.isclose(r.sum(), 1) and np.allclose(r, 0.15 / 12 / (0.15 / 12 + 0.85 * (M @ (r / M.sum(0)))).sum() + 0.85 * (M @ (r / M.sum(0))), atol=1e-3)
    blocks = np.kron(np.eye(2), np.ones((5, 5))) - np.eye(10) + 0.01
    assert len(set(gp.louvain(blocks)[:5])) == 1 and len(set(gp.louvain(blocks))) == 2
    levels, balance, _ = gp.spectral_levels(np.kron(np.eye(2), np.ones((4, 4))) + 0.1)
    assert len(set(levels[0])) == 1 and len(set(levels[1])) == 2 and balance["h_bal"] == balance["h_int"] - balance["h_seg"]


def test_small_world(spark):
    ring = gp.ring_lattice(random_graph(30, 0.2, 4), 3, np.random.default_rng(1))
    got = gp.small_world_propensity_of(ring, 1)
    assert 0 <= got["propensity"] <= 1 and got["delta_c"] < 0.3
    assert gp.small_world_sigma_of((ring != 0).astype(float), 5, 1) > 1


def test_two_core(spark):
    m = np.zeros((7, 7))
    for i, j in [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (5, 6)]:
        m[i, j] = m[j, i] = 1
    assert {(r.i, r.j) for r in gm.two_core(prep.from_matrix(m, spark)).collect()} == {(0, 1), (1, 2), (0, 2)}
    chain = np.diag(np.ones(24), 1)
    assert gm.two_core(prep.from_matrix(chain + chain.T, spark)).count() == 0


def test_backbone_of_equal_weights():
    m = np.ones((5, 5)) - np.eye(5)
    assert gp.in_rank(m)[:3] == [(3, 4), (2, 4), (2, 3)]
    assert gp.spanning_tree(m) == [(3, 4), (2, 4), (1, 4), (0, 4)]
    assert (gp.backbone(m, 2.4) != 0).sum() // 2 == 6


def test_partition_levels(spark):
    g = prep.from_matrix(np.kron(np.eye(2), np.ones((4, 4))) - np.eye(8) + 0.1 * (1 - np.eye(8)), spark)
    modules, balance = gp.nested_partition(g)
    rows = {r.level: r for r in gp.partition_levels(g).collect()}
    assert rows[0].modules == 1 and rows[1].modules == 2 and rows[1].share == 0 and len(rows) == 8
    b = balance.first()
    assert math.isclose(b.h_int, rows[0].h / 8) and math.isclose(b.h_seg, sum(rows[k].h for k in range(1, 8)) / 8) and math.isclose(b.h_bal, b.h_int - b.h_seg)
    assert modules.count() == 64


def test_directed_participation_and_borders(spark):
    directed = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0), (1, 2, 1.0), (3, 2, 3.0)], "i long, j long, w double")
    nodes, labels = spark.range(4).toDF("i"), spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "i long, module string")
    out = {r.i: r.participation for r in gm.participation_directed(directed, nodes, labels, []).collect()}
    into = {r.i: r.participation for r in gm.participation_directed(directed, nodes, labels, [], "in").collect()}
    assert out == {0: 0.5, 1: 0.0, 2: 0.0, 3: 0.0} and into == {0: 0.0, 1: 0.0, 2: 0.5, 3: 0.0}
    mesh = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 2), (3, 3)], "i long, j long")
    assert [(r.i, r.j) for r in gm.border_edges(mesh, labels.withColumnRenamed("module", "label")).collect()] == [(1, 2)]


def test_polylines(spark):
    edges = [(1, 2), (2, 3), (3, 4), (3, 5), (7, 6), (8, 7), (6, 8), (2, 1), (9, 9), (5, 10)]
    rows = gm.polylines(spark.createDataFrame([("a", i, j) for i, j in edges], "k string, i long, j long"), ["k"]).collect()
    lines = {}
    for r in sorted(rows, key=lambda r: (r.line, r.place)):
        lines.setdefault(r.line, []).append(r.i)
    assert list(lines.values()) == [[1, 2, 3], [3, 4], [3, 5, 10], [6, 7, 8, 6]]
    assert gm.polylines(spark.createDataFrame([], "i long, j long"), []).count() == 0


def test_matrices_with_both_triangles(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0 + 1e-9), (1, 1, 5.0), (1, 2, float("nan"))], "i long, j long, w double")
    assert [(r.i, r.j, r.w) for r in prep.from_directed(df, []).orderBy("i").collect()] == [(0, 1, 2.0), (1, 2, 0.0)]
    with pytest.raises(Exception, match="not symmetric"):
        prep.from_directed(df.union(spark.createDataFrame([(2, 0, 1.0)], df.schema)), []).collect()
    g = prep.from_matrix(np.array([[0, 2.0, 4], [2, 0, 6], [4, 6, 0]]), spark)
    assert sorted(r.w for r in prep.minmax_scale(g).collect()) == [0, 0.5, 1]
    assert np.allclose(sorted(r.w for r in prep.minmax_scale(g, diagonal=0.0).collect()), [1 / 3, 2 / 3, 1])
    with pytest.raises(ValueError):
        prep.minmax_scale(g, 1.0, 1.0)


def test_scrubbing(spark):
    marked = {3, 9, 10}
    rows = [(0, t, "motion_outlier00", float(t in marked)) for t in range(20)] + [(0, t, "csf", 1.0 + t) for t in range(20)]
    c = spark.createDataFrame(rows, "subject long, t long, name string, x double")
    assert [r.t for r in panel.kept_times(c, 5).orderBy("t").collect()] == [*range(4, 9), *range(11, 20)]
    assert [r.t for r in panel.kept_times(c, 1).orderBy("t").collect()] == [t for t in range(20) if t not in marked]
    p = spark.createDataFrame([(0, t, 0, 1.0) for t in range(20)], "subject long, t long, roi long, x double")
    assert panel.scrub(p, c, 6).count() == 9
    assert math.isclose(sum(r.x for r in panel.demean(c).filter("name = 'csf'").collect()), 0, abs_tol=1e-9)


def test_combined_atlas(spark):
    cortex = spark.createDataFrame([(1, 0), (2, 5), (3, 9), (4, 9)], "vertex long, parcel long")
    sub = spark.createDataFrame([(10, 2), (11, 7), (12, 0)], "vertex long, parcel long")
    assert {r.vertex: r.parcel for r in panel.combined_atlas(cortex, sub).collect()} == {10: 1, 11: 2, 12: 0, 1: 0, 2: 3, 3: 4, 4: 4}
    with pytest.raises(Exception, match="both atlases"):
        panel.combined_atlas(cortex, sub.union(spark.createDataFrame([(2, 2)], sub.schema))).collect()


def test_square_check(spark):
    with pytest.raises(ValueError):
        prep.from_matrix(np.zeros((2, 3)), spark)


# --- special functions ---


@settings(max_examples=60, deadline=None)
@given(st.floats(0.51, 0.999))
def test_t_quantile_closed_forms(q):
    assert math.isclose(special.t_quantile(q, 1), math.tan(math.pi * (q - 0.5)), rel_tol=1e-6)
    a = 4 * q * (1 - q)
    assert math.isclose(special.t_quantile(q, 2), 2 * (q - 0.5) * math.sqrt(2 / a), rel_tol=1e-6)
