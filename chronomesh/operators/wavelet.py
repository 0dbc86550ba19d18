"""Wavelet coherence with the Morlet wavelet (Torrence and Compo 1998; Torrence and Webster 1999)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


OMEGA = 6.0


def scales(fmin: float, fmax: float, n: int) -> tuple[np.ndarray, float]:
    """n scales from 1 / fmax on, and their spacing in octaves."""
    step = np.log2(fmax / fmin) / (n - 1)
    return 2.0 ** (step * np.arange(n)) / fmax, step


def transform(x: np.ndarray, dt: float, s: np.ndarray) -> np.ndarray:
    """Continuous wavelet transform (scales, times) by FFT with zero padding to a power of two."""
    n = len(x)
    size = 1 << int(np.ceil(np.log2(n)))
    omega = 2 * np.pi * np.fft.fftfreq(size, dt)
    psi = np.pi**-0.25 * np.exp(-0.5 * (np.outer(s, omega) - OMEGA) ** 2) * (omega > 0) * np.sqrt(2 * np.pi * s / dt)[:, None]
    return np.fft.ifft(np.fft.fft(x - x.mean(), size) * psi, axis=1)[:, :n]


def scale_window(step: float) -> np.ndarray:
    """Weights of neighbouring scales: about 1.2 octaves wide (twice the Morlet wavelet's decorrelation length of 0.6), ends counting half."""
    box = np.ones(max(1, round(2 * 0.6 / step)))
    box[0] = box[-1] = 0.5
    return box / box.sum()


def smooth(w: np.ndarray, dt: float, s: np.ndarray, step: float) -> np.ndarray:
    """Gaussian of a scale's width over time, then scale_window() over scales; beyond the outer scales there is nothing (zeros)."""
    m, n = w.shape
    size = 1 << int(np.ceil(np.log2(n)))
    k = 2 * np.pi * np.fft.fftfreq(size)
    kernel = np.exp(-0.5 * np.outer((s / dt) ** 2, k**2))
    out = np.fft.ifft(np.fft.fft(w, size, axis=1) * kernel, axis=1)[:, :n]
    box = scale_window(step)
    before = (len(box) - 1) // 2  # a window of even width reaches further towards the smaller scales
    long = np.pad(out, ((len(box) - 1 - before, before), (0, 0)))
    made = sum(b * long[len(box) - 1 - k : len(box) - 1 - k + m] for k, b in enumerate(box))
    return made if np.iscomplexobj(w) else made.real


def coherence(a: np.ndarray, b: np.ndarray, dt: float, s: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared coherence and smoothed cross power of two transforms."""
    inv = 1 / s[:, None]
    sa, sb = smooth(np.abs(a) ** 2 * inv, dt, s, step), smooth(np.abs(b) ** 2 * inv, dt, s, step)
    cross = smooth(a * b.conj() * inv, dt, s, step)
    return np.clip(np.abs(cross) ** 2 / np.maximum(sa * sb, 1e-300), 0, 1), np.abs(a * b.conj())


def _pairs(p: DataFrame, t_r: float, s: np.ndarray) -> DataFrame:
    """(subject, t0, i, j, ar, ai, br, bi): both transforms of each pair of regions, real and imaginary parts as flat arrays."""
    kind = p.schema["roi"].dataType.simpleString()

    def series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        w = transform(rows["x"].to_numpy(float), t_r, s)
        return pd.DataFrame({"subject": [rows["subject"].iloc[0]], "roi": [rows["roi"].iloc[0]], "t0": [int(rows["t"].iloc[0])], "re": [w.real.ravel()], "im": [w.imag.ravel()]})

    made = p.groupBy("subject", "roi").applyInPandas(series, f"subject long, roi {kind}, t0 long, re array<double>, im array<double>")
    a = made.select("subject", "t0", F.col("roi").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = made.select("subject", F.col("roi").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    return a.join(b, "subject").filter("i < j")


def _both(r, n_scales: int) -> list[np.ndarray]:
    return [np.array(re).reshape(n_scales, -1) + 1j * np.array(im).reshape(n_scales, -1) for re, im in ((r.ar, r.ai), (r.br, r.bi))]


def wavelet_coherence(
    p: DataFrame, t_r: float = 0.72, fmin: float = 0.007, fmax: float = 0.15, n_scales: int = 15, drop_scales: int = 2, drop_times: int = 50
) -> DataFrame:
    """(subject, t, i, j, w): 1 minus the coherence averaged over scales with the share of cross power as weight.

    drop_scales outer scales and drop_times first and last times are left out; a series needs over twice drop_times.
    One kernel per region holds its transform once; pairs meet in a join and one kernel per pair.
    """
    kind = p.schema["roi"].dataType.simpleString()
    s, step = scales(fmin, fmax, n_scales)
    cut = slice(drop_scales, n_scales - drop_scales) if drop_scales else slice(None)

    def pair(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                c, power = coherence(*_both(r, n_scales), t_r, s, step)
                n = c.shape[1]
                if n <= 2 * drop_times:
                    raise ValueError("a series needs more than twice drop_times times")
                keep = slice(drop_times, n - drop_times) if drop_times else slice(None)
                c, power = c[cut, keep], power[cut, keep]
                w = 1 - (power / np.maximum(power.sum(0), 1e-300) * c).sum(0)
                yield pd.DataFrame({"subject": r.subject, "t": r.t0 + np.arange(n)[keep], "i": r.i, "j": r.j, "w": w})

    return _pairs(p, t_r, s).mapInPandas(pair, f"subject long, t long, i {kind}, j {kind}, w double")


def coherence_by_scale(p: DataFrame, t_r: float = 0.72, fmin: float = 0.007, fmax: float = 0.15, n_scales: int = 15) -> DataFrame:
    """(subject, t, i, j, scale, period, c): the squared coherence of each pair at every scale and time, none left out."""
    kind = p.schema["roi"].dataType.simpleString()
    s, step = scales(fmin, fmax, n_scales)

    def pair(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                c, _ = coherence(*_both(r, n_scales), t_r, s, step)
                for k in range(n_scales):
                    yield pd.DataFrame({"subject": r.subject, "t": r.t0 + np.arange(c.shape[1]), "i": r.i, "j": r.j, "scale": k, "period": s[k], "c": c[k]})

    return _pairs(p, t_r, s).mapInPandas(pair, f"subject long, t long, i {kind}, j {kind}, scale int, period double, c double")
