"""Estimators with a recursion over time: flexible least squares, GARCH and dynamic conditional correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.kernels import nelder_mead
from chronomesh.operators.panel import standardise


def _wide(rows: pd.DataFrame, value: str = "x") -> tuple[np.ndarray, list, np.ndarray]:
    wide = rows.pivot(index="t", columns="roi", values=value).sort_index()
    return wide.to_numpy(float), list(wide.columns), wide.index.to_numpy()


def _long(subject, times: np.ndarray, names: list, cube: np.ndarray) -> pd.DataFrame:
    """Edge rows of a (T, P, P) cube's upper triangle."""
    a, b = np.triu_indices(len(names), 1)
    n, e = len(times), len(a)
    return pd.DataFrame({"subject": subject, "t": np.repeat(times, e), "i": [names[k] for k in a] * n, "j": [names[k] for k in b] * n, "w": cube[:, a, b].ravel()})


def fls_paths(x: np.ndarray, mu: float) -> np.ndarray:
    """Coefficient paths (T, P, P): [t, i, j] of series j on series i, solved for all targets at once by elimination.

    For a source the system is tridiagonal: x_t^2 + mu (ends) or + 2 mu (inside) on the diagonal, -mu beside it.
    """
    n, p = x.shape
    diag = x**2 + np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), mu, 2 * mu)[:, None]
    rhs = x[:, :, None] * x[:, None, :]
    c, d = np.empty((n, p)), np.empty((n, p, p))
    c[0], d[0] = -mu / diag[0], rhs[0] / diag[0][:, None]
    for t in range(1, n):
        m = diag[t] + mu * c[t - 1]
        c[t] = -mu / m
        d[t] = (rhs[t] + mu * d[t - 1]) / m[:, None]
    for t in range(n - 2, -1, -1):
        d[t] -= c[t][:, None] * d[t + 1]
    return d


def flexible_least_squares(p: DataFrame, mu: float = 100.0, standardised: bool = True) -> DataFrame:
    """(subject, t, i, j, w): mean of both directions' coefficient paths. One kernel per subject, linear in its times."""
    kind = p.schema["roi"].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x, names, times = _wide(rows)
        b = fls_paths(x, mu)
        return _long(rows["subject"].iloc[0], times, names, (b + b.transpose(0, 2, 1)) / 2)

    return (standardise(p) if standardised else p).groupBy("subject").applyInPandas(solve, f"subject long, t long, i {kind}, j {kind}, w double")


def garch_variances(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """h_0 = mean(x^2); h_t = a + b x_{t-1}^2 + c h_{t-1}."""
    h = np.empty(len(x))
    h[0] = np.mean(x**2)
    for t in range(1, len(x)):
        h[t] = theta[0] + theta[1] * x[t - 1] ** 2 + theta[2] * h[t - 1]
    return h


def garch_filter(p: DataFrame, theta: tuple[float, float, float]) -> DataFrame:
    """(subject, t, roi, h): conditional variances of each series under fixed parameters."""
    kind = p.schema["roi"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        return rows[["subject", "t", "roi"]].assign(h=garch_variances(rows["x"].to_numpy(float), np.array(theta)))

    return p.groupBy("subject", "roi").applyInPandas(run, f"subject long, t long, roi {kind}, h double")


def fit_garch(x: np.ndarray) -> np.ndarray:
    """Parameters that minimise the sum of x^2 / h + ln h over all but the last time; positive, with b + c < 1."""
    scale = np.mean(x**2) or 1.0

    def cost(theta: np.ndarray) -> float:
        if theta.min() < 0 or theta[1] + theta[2] >= 1:
            return 1e10
        h = garch_variances(x, theta)[:-1]
        return float(np.sum(x[:-1] ** 2 / h + np.log(h))) if h.min() > 0 else 1e10

    starts = [np.array([scale * (1 - b - c), b, c]) for b, c in ((0.05, 0.9), (0.25, 0.25), (0.1, 0.6))]
    return min((nelder_mead(cost, s) for s in starts), key=cost)


def dcc_recursion(eps: np.ndarray, s: np.ndarray, a: float, b: float) -> np.ndarray:
    """Correlations R_t from residuals up to and including t: Q_t = S (1 - a - b) + a z z' + b Q_{t-1} with Q_{-1} = S and
    z = eps_t sqrt(diag Q_{t-1}); R_t is Q_t normalised."""
    n, p = eps.shape
    q, out = s.copy(), np.empty((n, p, p))
    for t in range(n):
        z = eps[t] * np.sqrt(np.diag(q))
        q = s * (1 - a - b) + a * np.outer(z, z) + b * q
        d = 1 / np.sqrt(np.diag(q))
        out[t] = q * np.outer(d, d)
    return out


def dcc_forecasts(eps: np.ndarray, s: np.ndarray, a: float, b: float) -> np.ndarray:
    """Correlations that are known before each time, by which the likelihood judges its residuals: S at first, then R_{t-1}."""
    d = 1 / np.sqrt(np.diag(s))
    return np.concatenate([(s * np.outer(d, d))[None], dcc_recursion(eps[:-1], s, a, b)])


def fit_dcc(eps: np.ndarray) -> tuple[float, float]:
    s = np.cov(eps.T)

    def cost(theta: np.ndarray) -> float:
        a, b = theta
        if a < 0 or b < 0 or a + b >= 1:
            return 1e10
        r = dcc_forecasts(eps, s, a, b)
        sign, logdet = np.linalg.slogdet(r)
        if (sign <= 0).any():
            return 1e10
        return float(logdet.sum() + (eps * np.linalg.solve(r, eps[:, :, None])[:, :, 0]).sum())

    return tuple(min((nelder_mead(cost, np.array(x), rounds=120) for x in ((0.05, 0.9), (0.25, 0.25))), key=cost))


def garch_residuals(p: DataFrame) -> DataFrame:
    """(subject, t, roi, x, sd, omega, alpha, beta): residuals of a GARCH(1, 1) fit to each demeaned series, its conditional deviations and parameters."""
    kind = p.schema["roi"].dataType.simpleString()

    def univariate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x = rows["x"].to_numpy(float)
        x = x - x.mean()
        theta = fit_garch(x) if np.any(x) else np.array([1.0, 0.0, 0.0])
        h = garch_variances(x, theta) if np.any(x) else np.ones(len(x))
        return rows[["subject", "t", "roi"]].assign(x=x / np.sqrt(h), sd=np.sqrt(h), omega=theta[0], alpha=theta[1], beta=theta[2])

    return p.groupBy("subject", "roi").applyInPandas(univariate, f"subject long, t long, roi {kind}, x double, sd double, omega double, alpha double, beta double")


def garch_parameters(residuals: DataFrame) -> DataFrame:
    """(subject, roi, omega, alpha, beta) of garch_residuals()."""
    return residuals.groupBy("subject", "roi").agg(*[F.first(c).alias(c) for c in ("omega", "alpha", "beta")])


def dcc_parameters(residuals: DataFrame) -> DataFrame:
    """(subject, a, b): the correlation recursion's parameters, fitted to garch_residuals()."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = fit_dcc(_wide(rows)[0])
        return pd.DataFrame({"subject": [rows["subject"].iloc[0]], "a": [a], "b": [b]})

    return residuals.groupBy("subject").applyInPandas(run, "subject long, a double, b double")


def dynamic_conditional_correlation(p: DataFrame, theta: tuple[float, float] | None = None) -> DataFrame:
    """(subject, t, i, j, w, h): DCC correlations and covariances h. Series are demeaned before the GARCH fits.

    The univariate fits run in parallel over (subject, roi); a second kernel per subject fits and runs the recursion,
    or only runs it under fixed theta. The fitted parameters are those of garch_parameters() and dcc_parameters().
    """
    kind = p.schema["roi"].dataType.simpleString()

    def joint(rows: pd.DataFrame) -> pd.DataFrame:
        eps, names, times = _wide(rows)
        sd, _, _ = _wide(rows, "sd")
        a, b = theta or fit_dcc(eps)
        r = dcc_recursion(eps, np.corrcoef(eps.T), a, b)
        out = _long(rows["subject"].iloc[0], times, names, r)
        out["h"] = _long(0, times, names, r * sd[:, :, None] * sd[:, None, :])["w"]
        return out

    return garch_residuals(p).groupBy("subject").applyInPandas(joint, f"subject long, t long, i {kind}, j {kind}, w double, h double")


def dcc_filter(residuals: DataFrame, a: float, b: float) -> DataFrame:
    """(subject, t, i, j, w): the DCC recursion over given standardised residuals (a panel) under fixed parameters."""
    kind = residuals.schema["roi"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        eps, names, times = _wide(rows)
        return _long(rows["subject"].iloc[0], times, names, dcc_recursion(eps, np.corrcoef(eps.T), a, b))

    return residuals.groupBy("subject").applyInPandas(run, f"subject long, t long, i {kind}, j {kind}, w double")
