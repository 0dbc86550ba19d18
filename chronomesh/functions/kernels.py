"""NumPy kernels for single groups: optimiser, clustering, hidden Markov models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 400, tolerance: float = 1e-9) -> np.ndarray:
    """Downhill simplex minimisation; f gives a large value outside its domain."""
    n = len(start)
    simplex = np.vstack([start] + [start + np.eye(n)[k] * (0.05 * start[k] if start[k] else 0.00025) for k in range(n)])
    values = np.array([f(x) for x in simplex])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        simplex, values = simplex[order], values[order]
        if values[-1] - values[0] < tolerance * (1 + abs(values[0])) and np.abs(simplex[1:] - simplex[0]).max() < 1e-8:
            break
        centre = simplex[:-1].mean(0)
        tried = centre + (centre - simplex[-1])
        got = f(tried)
        if got < values[0]:
            far = centre + 2 * (centre - simplex[-1])
            further = f(far)
            simplex[-1], values[-1] = (far, further) if further < got else (tried, got)
        elif got < values[-2]:
            simplex[-1], values[-1] = tried, got
        else:
            inner = centre + 0.5 * ((tried if got < values[-1] else simplex[-1]) - centre)
            less = f(inner)
            if less < min(got, values[-1]):
                simplex[-1], values[-1] = inner, less
            else:
                simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
                values[1:] = [f(x) for x in simplex[1:]]
    return simplex[np.argmin(values)]


def kmeans(x: np.ndarray, k: int, n_init: int = 50, seed: int | None = None, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Lloyd's algorithm from k-means++ starts: centroids sorted by their coordinates, labels, inertia of the best start."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    best: tuple = (np.inf, None)
    for _ in range(n_init):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]])
        for _ in range(rounds):
            d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
            labels = d.argmin(1)
            new = np.stack([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres, atol=1e-12):
                break
            centres = new
        inertia = float(((x - centres[labels]) ** 2).sum())
        if inertia < best[0] - 1e-12:
            best = (inertia, centres)
    centres = best[1][np.lexsort(best[1].T[::-1])]
    labels = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1) if len(x) * k * x.shape[1] < 5e7 else ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
    return centres, labels, best[0]


def _forward_backward(logs: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n, k = logs.shape
    shift = logs.max(1, keepdims=True)
    b = np.exp(logs - shift)
    alpha, scale = np.empty((n, k)), np.empty(n)
    for t in range(n):
        a = (start if t == 0 else alpha[t - 1] @ trans) * b[t]
        scale[t] = a.sum() or 1e-300
        alpha[t] = a / scale[t]
    beta = np.ones((n, k))
    xi = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        nxt = b[t + 1] * beta[t + 1] / scale[t + 1]
        beta[t] = trans @ nxt
        xi += alpha[t][:, None] * trans * nxt
    gamma = alpha * beta
    return float(np.log(scale).sum() + shift.sum()), gamma / gamma.sum(1, keepdims=True), xi


def viterbi(logs: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, k = logs.shape
    with np.errstate(divide="ignore"):
        log_trans, score = np.log(trans), np.log(start) + logs[0]
    back = np.empty((n, k), int)
    for t in range(1, n):
        all_ = score[:, None] + log_trans
        back[t] = all_.argmax(0)
        score = all_.max(0) + logs[t]
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def gaussian_logs(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, k] = -0.5 * ((z**2).sum(0) + 2 * np.log(np.diag(low)).sum() + x.shape[1] * np.log(2 * np.pi))
    return out


def gaussian_hmm(x: np.ndarray, k: int, seed: int, rounds: int = 60, floor: float = 1e-3) -> dict:
    """Baum-Welch for a full-covariance Gaussian HMM from a k-means start."""
    n, p = x.shape
    means, labels, _ = kmeans(x, k, n_init=1, seed=seed)
    k = len(means)
    base = np.cov(x.T, bias=True).reshape(p, p) + floor * np.eye(p)
    covs, start, trans = np.stack([base] * k), np.full(k, 1 / k), np.full((k, k), 1 / k)
    before = -np.inf
    for _ in range(rounds):
        score, gamma, xi = _forward_backward(gaussian_logs(x, means, covs), start, trans)
        if score - before < 1e-2:
            break
        before = score
        start, trans = gamma[0], (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True)
        mass = gamma.sum(0) + 1e-9
        means = gamma.T @ x / mass[:, None]
        covs = np.stack([((gamma[:, c, None] * (x - means[c])).T @ (x - means[c])) / mass[c] + floor * np.eye(p) for c in range(k)])
    return {"score": score, "means": means, "covs": covs, "labels": viterbi(gaussian_logs(x, means, covs), start, trans)}


def categorical_hmm(obs: np.ndarray, symbols: int, k: int, seed: int, rounds: int = 100) -> dict:
    """Baum-Welch for an HMM with categorical emissions from a random start."""
    rng = np.random.default_rng(seed)
    start, trans, emit = np.full(k, 1 / k), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k)
    before = -np.inf
    for _ in range(rounds):
        logs = np.log(emit[:, obs].T + 1e-300)
        score, gamma, xi = _forward_backward(logs, start, trans)
        if score - before < 1e-3:
            break
        before = score
        start, trans = gamma[0], (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True)
        emit = np.stack([np.bincount(obs, gamma[:, c], symbols) for c in range(k)]) + 1e-12
        emit /= emit.sum(1, keepdims=True)
    return {"score": score, "labels": viterbi(np.log(emit[:, obs].T + 1e-300), start, trans)}
