"""NumPy kernels on small dense arrays: one draw of paths at a time, inside Arrow or pandas functions."""

from __future__ import annotations

import numpy as np


def lag_curve(paths: np.ndarray, k_min: int, k_max: int, leverage: bool = False) -> np.ndarray:
    """(paths, lags): correlation over n of |r| (or r) with |r| later, by FFT; zeros for flat paths, NaN beyond the length."""
    n, t = paths.shape
    late = np.abs(paths)
    late = late - late.mean(axis=1, keepdims=True)
    early = paths - paths.mean(axis=1, keepdims=True) if leverage else late
    size = 1 << (2 * t - 1).bit_length()
    cross = np.fft.irfft(np.conj(np.fft.rfft(early, size)) * np.fft.rfft(late, size), size)
    ss = np.sqrt((early * early).sum(axis=1) * (late * late).sum(axis=1))
    flat = (early.std(axis=1) < 1e-10) | (late.std(axis=1) < 1e-10)
    out = np.full((n, k_max - k_min + 1), np.nan)
    top = min(k_max, t - 1)
    if top >= k_min:
        out[:, : top - k_min + 1] = np.where(flat[:, None], 0.0, cross[:, k_min : top + 1] / np.where(flat, 1.0, ss)[:, None])
    return out


def curve_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Mean difference of the mean curves over lags that both have."""
    with np.errstate(invalid="ignore"):
        d = np.abs(_nanmean(a) - _nanmean(b))
    return float(d[~np.isnan(d)].mean()) if (~np.isnan(d)).any() else float("nan")


def _nanmean(x: np.ndarray) -> np.ndarray:
    n = (~np.isnan(x)).sum(axis=0)
    return np.where(n > 0, np.nansum(x, axis=0) / np.maximum(n, 1), np.nan)


def tail_gap(a: np.ndarray, b: np.ndarray, tail: float = 0.05, grid: int = 1000) -> float:
    u = (np.arange(grid) + 0.5) / grid
    u = u[(u < tail) | (u > 1 - tail)]
    return float(np.abs(np.quantile(a.ravel(), u) - np.quantile(b.ravel(), u)).mean())


def l_kurtosis(x: np.ndarray) -> float:
    n = len(x)
    if n < 4:
        return float("nan")
    x, j = np.sort(x), np.arange(n, dtype=float)
    w, b = np.ones(n), []
    for k in range(4):
        b.append((w * x).mean())
        w = w * (j - k) / max(n - 1 - k, 1)
    second, fourth = 2 * b[1] - b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]
    return fourth / second if abs(second) >= 1e-12 else float("nan")


def kurtosis_gap(a: np.ndarray, b: np.ndarray, horizons=(1, 5, 30, 60, 390), weights=None) -> float:
    weights = weights or [1.0 / h for h in horizons]
    total = share = 0.0
    for h, w in zip(horizons, weights, strict=True):
        blocks = [x.ravel()[: x.size // h * h].reshape(-1, h).sum(axis=1) for x in (a, b)]
        if min(map(len, blocks)) < 30:
            continue
        gap = abs(l_kurtosis(blocks[0]) - l_kurtosis(blocks[1]))
        if not np.isnan(gap):
            total, share = total + w * gap, share + w
    return total / share if share else float("nan")


def scale_correlation(paths: np.ndarray, scales=(5, 20, 60, 120)) -> np.ndarray:
    """(paths, scales, scales), NaN for paths with a flat volatility; empty where the largest scale doesn't fit."""
    t, top = paths.shape[1], max(scales)
    if t < top:
        return np.empty((0, len(scales), len(scales)))
    total = np.concatenate([np.zeros((len(paths), 1)), np.cumsum(paths * paths, axis=1)], axis=1)
    v = np.stack([np.sqrt(np.maximum((total[:, top:] - total[:, top - s : t + 1 - s]) / s, 0)) for s in scales], axis=1)
    v = v - v.mean(axis=2, keepdims=True)
    ss = (v * v).sum(axis=2)
    sound = (ss > 1e-8).all(axis=1)
    unit = v / np.sqrt(np.where(ss > 0, ss, 1.0))[:, :, None]
    out = unit @ unit.transpose(0, 2, 1)
    out[~sound] = np.nan
    return out


def correlation_gap(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (x[~np.isnan(x).any(axis=(1, 2))] for x in (a, b))
    return float(np.sqrt(((a.mean(axis=0) - b.mean(axis=0)) ** 2).sum())) if len(a) and len(b) else float("nan")


def rolling_vol(paths: np.ndarray, lookback: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Returns from ``lookback`` on and the sample deviation of those before each."""
    if paths.shape[1] <= lookback:
        return np.empty(0), np.empty(0)
    view = np.lib.stride_tricks.sliding_window_view(paths, lookback, axis=1)[:, :-1]
    return paths[:, lookback:].ravel(), view.std(axis=2, ddof=1).ravel()


def theta_grid(top: float, mean: float) -> np.ndarray:
    """Sorted thetas = xi / sigma to begin with, all with 1 + theta * x > 0 for x up to ``top``; shapes below -1 have unbounded likelihood."""
    return np.sort(np.r_[-(1 - np.geomspace(1e-6, 1, 200)[:-1]) / top, 0.0, np.geomspace(1e-6, 1e4, 400) / mean])


def profile(theta: np.ndarray, shape: np.ndarray, mean: float) -> np.ndarray:
    """Mean profile log-likelihood of a generalised Pareto law from 0 (Grimshaw); ``shape`` is the mean of log1p(theta * x), the best xi."""
    near = np.abs(theta) * mean < 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -np.log(np.where(near, mean, shape / theta)) - shape - 1
    return np.where(near, -np.log(mean) - 1, out)


def narrowed(theta: np.ndarray, shape: np.ndarray, mean: float, first: bool, points: int = 64) -> tuple[float, np.ndarray]:
    """The shape at the best theta of a grid, and a finer grid between its neighbours."""
    if first:
        sound = (shape > -1) | (theta >= 0)
        theta, shape = theta[sound], shape[sound]
    k = int(np.nanargmax(profile(theta, shape, mean)))
    return float(shape[k]), np.linspace(theta[max(k - 1, 0)], theta[min(k + 1, len(theta) - 1)], points)


def gpd_shape(x: np.ndarray) -> float:
    """Maximum likelihood shape of a generalised Pareto law from 0, by golden section between the best grid point's neighbours."""
    top, mean = float(x.max()), float(x.mean())
    if not top > 0:
        return float("nan")

    def shape(theta):
        return np.log1p(np.multiply.outer(theta, x)).mean(axis=-1)

    grid = theta_grid(top, mean)
    _, around = narrowed(grid, shape(grid), mean, True)
    lo, hi = around[0], around[-1]
    level = lambda t: profile(np.array([t]), shape(np.array([t])), mean)[0]
    for _ in range(60):
        a, b = hi - 0.6180339887498949 * (hi - lo), lo + 0.6180339887498949 * (hi - lo)
        lo, hi = (lo, b) if level(a) >= level(b) else (a, hi)
    return float(shape(np.array([(lo + hi) / 2]))[0])


def tail_regime_gap(a, b, bounds: list[float], tail: float = 0.05) -> float:
    """a, b: (returns, volatilities). Mean difference of shapes over regimes where both have enough exceedances."""
    gaps = []
    edges = [-np.inf, *bounds, np.inf]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        xi = []
        for r, v in (a, b):
            m = np.abs(r[(v >= lo) & (v < hi)])
            u = np.quantile(m, 1 - tail) if len(m) else 0.0
            e = m[m > u] - u
            xi.append(gpd_shape(e) if len(e) >= 50 else float("nan"))
        if not np.isnan(xi).any():
            gaps.append(abs(xi[0] - xi[1]))
    return float(np.mean(gaps)) if gaps else float("nan")
