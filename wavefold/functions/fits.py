"""Models of many series at once: ARMA by conditional least squares and GARCH by likelihood.

The recursions run over time once for all series, orders and trial parameters of
a batch, which are the columns of numpy arrays, so no loop in Python is longer
than a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

#: Values of the series that are fitted at once, about.
BATCH = 20_000


def series_batches(frames: Iterator[pd.DataFrame], key: list[str], value: str, size: int = BATCH) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Keys and values of series whose rows come next to each other and in order, about size values at a time."""
    keys, parts, held = [], [], 0

    def whole() -> tuple[list[tuple], list[np.ndarray]]:
        return keys, [np.concatenate(p) for p in parts]

    for df in frames:
        if not len(df):
            continue
        new = np.zeros(len(df), bool)
        new[0] = True
        for k in key:
            c = df[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        bounds = np.r_[np.flatnonzero(new), len(df)]
        values = df[value].to_numpy(float)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = tuple(df[k].iat[a] for k in key)
            if not keys or own != keys[-1]:
                if held >= size:
                    yield whole()
                    keys, parts, held = [], [], 0
                keys.append(own)
                parts.append([])
            parts[-1].append(values[a:b])
            held += b - a
    if keys:
        yield whole()


def _lagged(x: np.ndarray, lags: int) -> np.ndarray:
    """(rows, lags, n): x delayed by 1, 2, ... with zeros before its start."""
    out = np.zeros((x.shape[0], lags, x.shape[1]))
    for j in range(1, lags + 1):
        out[:, j - 1, j:] = x[:, : x.shape[1] - j]
    return out


def _residuals(z: np.ndarray, past: np.ndarray, inside: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Residuals of z (rows, n) given its delayed values, for coefficients of each row; zero outside the series."""
    e = z - np.einsum("bj,bjn->bn", ar, past)
    e *= inside
    q = ma.shape[1]
    used = [j for j in range(q) if ma[:, j].any()]
    if used:
        lead = np.ascontiguousarray(e.T)
        for t in range(1, lead.shape[0]):
            for j in used:
                if t > j:
                    lead[t] -= ma[:, j] * lead[t - 1 - j]
            np.clip(lead[t], -1e100, 1e100, out=lead[t])
        e = lead.T * inside
    return e


def arma_fits(series: list[np.ndarray], d: list[int], orders: tuple, steps: int = 12) -> list[list[dict]]:
    """ARIMA(p, d, q) of every series for all orders (p, q): by regression on long autoregression's residuals, then Gauss-Newton on the conditional sum of squares; AIC and BIC of the Gaussian likelihood.

    Every fit has order, ar, ma, mean, z, resid, aic, bic and x.
    """
    w = [np.diff(np.asarray(x, float), k) if k else np.asarray(x, float) for x, k in zip(series, d)]
    mean = np.array([x.mean() if not k and len(x) else 0.0 for x, k in zip(w, d)])
    size = np.array([len(x) for x in w])
    n = int(size.max(initial=1))
    z = np.zeros((len(w), n))
    for i, x in enumerate(w):
        z[i, : len(x)] = x - mean[i]
    inside = np.arange(n)[None] < size[:, None]
    P, Q = max(p for p, _ in orders), max(q for _, q in orders)
    scale = np.sqrt(np.maximum((z * z).sum(1) / np.maximum(size, 1), 1e-300))[:, None]
    z = z / scale
    past = _lagged(z, P) if P else np.zeros((len(w), 0, n))
    # First guesses: the residuals of a long autoregression stand for the shocks.
    long = 8
    wide = _lagged(z, long)
    ready = inside & (np.arange(n) >= np.minimum(long, size // 4)[:, None])
    keep = np.arange(long) < np.minimum(long, size // 4)[:, None]
    a = wide * ready[:, None] * keep[:, :, None]
    first = _solved(a @ a.transpose(0, 2, 1), (a @ (z * ready)[:, :, None])[:, :, 0], keep)
    shock = (z - np.einsum("bj,bjn->bn", first, wide)) * ready
    both = np.concatenate([past, _lagged(shock, Q)], 1) if Q else past
    ready = ready & (np.arange(n) >= np.minimum(long, size // 4)[:, None] + max(P, Q))
    a = both * ready[:, None]
    gram, target = a @ a.transpose(0, 2, 1), (a @ (z * ready)[:, :, None])[:, :, 0]
    s, k = len(w), len(orders)
    mask = np.array([[j < p for j in range(P)] + [j < q for j in range(Q)] for p, q in orders], bool).reshape(k, P + Q)
    room = np.array([[x > p + q + 2 for p, q in orders] for x in size])
    mask = (mask[None] & room[:, :, None]).reshape(s * k, P + Q)
    row = np.repeat(np.arange(s), k)
    theta = np.where(mask, np.clip(_solved(gram[row], target[row], mask), -0.95, 0.95), 0.0)
    zz, pp, ii = z[row], past[row], inside[row]

    def resid(t: np.ndarray, of: np.ndarray) -> np.ndarray:
        return _residuals(zz[of], pp[of], ii[of], t[:, :P], t[:, P:])

    every = np.arange(s * k)
    e = resid(theta, every)
    loss = (e * e).sum(1)
    damp = np.full(s * k, 1e-3)
    live = mask.any(1)
    for _ in range(steps):
        of = np.flatnonzero(live)
        if not len(of):
            break
        jac = np.zeros((len(of), P + Q, n))
        for j in range(P + Q):
            mine = mask[of, j]
            if mine.any():
                moved = theta[of[mine]].copy()
                moved[:, j] += 1e-6
                jac[mine, j] = (resid(moved, of[mine]) - e[of[mine]]) / 1e-6
        with np.errstate(all="ignore"):
            jac = np.nan_to_num(np.clip(jac, -1e60, 1e60))
            g = np.einsum("bjn,bn->bj", jac, e[of])
            h = jac @ jac.transpose(0, 2, 1)
            h[:, range(P + Q), range(P + Q)] *= 1 + damp[of, None]
            trial = theta[of] - _solved(h, g, mask[of])
        new = resid(trial, of)
        with np.errstate(all="ignore"):
            value = np.nan_to_num((new * new).sum(1), nan=np.inf)
        better = value < loss[of]
        gain = (loss[of] - value)[better] / np.maximum(loss[of][better], 1e-300)
        take = of[better]
        theta[take], e[take], loss[take] = trial[better], new[better], value[better]
        damp[of] = np.where(better, damp[of] / 5, damp[of] * 10)
        live[take[gain < 1e-9]] = False
        live[of[~better & (damp[of] > 1e6)]] = False
    out = []
    for i in range(s):
        own = []
        for j, (p, q) in enumerate(orders):
            b = i * k + j
            m, u = int(size[i]), float(scale[i, 0])
            s2 = max(float(loss[b]) / max(m, 1) * u * u, 1e-300)
            like = -0.5 * m * (math.log(2 * math.pi * s2) + 1)
            c = p + q + 1 + (not d[i])
            own.append({"order": (p, d[i], q), "ar": theta[b, :p].copy(), "ma": theta[b, P : P + q].copy(), "mean": float(mean[i]), "resid": e[b, :m] * u, "aic": -2 * like + 2 * c, "bic": -2 * like + c * math.log(max(m, 2)), "z": z[i, :m] * u, "x": np.asarray(series[i], float)})
        out.append(own)
    return out


def _solved(h: np.ndarray, g: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Solutions of h x = g in the coordinates that mask has, zero in the others, slightly regularised."""
    h = np.where(mask[:, :, None] & mask[:, None], h, 0.0)
    g = np.where(mask, g, 0.0)
    at = range(h.shape[1])
    h[:, at, at] += np.where(mask, 1e-9 + 1e-10 * np.abs(h[:, at, at]), 1.0)
    return np.linalg.solve(h, g[:, :, None])[:, :, 0] if h.shape[1] else g


def simplex(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, steps: int = 200, size: float = 0.5, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Minimise a function from every row of start by the downhill simplex, all in step; f(points, rows) has the values of points for the rows of start they are of."""
    b, d = start.shape
    points = np.concatenate([start[:, None], start[:, None] + size * np.eye(d)[None]], 1)
    values = f(points.reshape(-1, d), np.repeat(np.arange(b), d + 1)).reshape(b, d + 1)
    live = np.arange(b)
    for _ in range(steps):
        order = np.argsort(values[live], 1, kind="stable")
        points[live] = np.take_along_axis(points[live], order[:, :, None], 1)
        values[live] = np.take_along_axis(values[live], order, 1)
        live = live[np.abs(values[live, -1] - values[live, 0]) > tol * (np.abs(values[live, 0]) + tol)]
        if not len(live):
            break
        p, v = points[live], values[live]
        centre = p[:, :-1].mean(1)
        tried = np.stack([centre + t * (p[:, -1] - centre) for t in (-1.0, -2.0, -0.5, 0.5)], 1)
        got = f(tried.reshape(-1, d), np.repeat(live, 4)).reshape(-1, 4)
        pick = np.where(got[:, 0] < v[:, 0], np.where(got[:, 1] < got[:, 0], 1, 0), np.where(got[:, 0] < v[:, -2], 0, np.where(got[:, 0] < v[:, -1], 2, 3)))
        row = np.arange(len(live))
        value = got[row, pick]
        shrink = (pick >= 2) & (value >= np.minimum(got[:, 0], v[:, -1]))
        points[live, -1] = np.where(shrink[:, None], p[:, -1], tried[row, pick])
        values[live, -1] = np.where(shrink, v[:, -1], value)
        small = live[shrink]
        if len(small):
            points[small, 1:] = points[small, :1] + 0.5 * (points[small, 1:] - points[small, :1])
            values[small, 1:] = f(points[small, 1:].reshape(-1, d), np.repeat(small, d)).reshape(-1, d)
    best = values.argmin(1)
    return points[np.arange(b), best], values[np.arange(b), best]


#: Starts (omega as a share of the variance, alpha, beta), tried in this order.
GARCH_STARTS = ((0.05, 0.10, 0.80), (0.01, 0.05, 0.90), (0.10, 0.20, 0.70), (0.001, 0.15, 0.75), (0.02, 0.12, 0.12))


def _split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = 0.9999 / (1 + np.exp(-np.clip(p[:, 1], -30, 30)))
    share = 1 / (1 + np.exp(-np.clip(p[:, 2], -30, 30)))
    return np.exp(np.clip(p[:, 0], -25, 5)), total * share, total * (1 - share)


def garch_fits(series: list[np.ndarray]) -> list[dict]:
    """GARCH(1, 1) of demeaned series by Gaussian likelihood, the best of several starts; constant variance where a series is short or does not vary."""
    out: list = [None] * len(series)
    fit = []
    for i, x in enumerate(series):
        x = np.asarray(x, float)
        r = x - x.mean() if len(x) else x
        var = float(r.var()) if len(r) else 0.0
        if len(r) < 10 or var < 1e-14:
            out[i] = {"omega": var, "alpha": 0.0, "beta": 0.0, "persistence": 0.0, "half_life": None, "converged": False, "cond_vol": [math.sqrt(var)] * len(r)}
        else:
            fit.append((i, r / math.sqrt(var), var))
    if not fit:
        return out
    size = np.array([len(z) for _, z, _ in fit])
    z = np.zeros((len(fit), size.max()))
    for k, (_, x, _) in enumerate(fit):
        z[k, : len(x)] = x
    square = np.ascontiguousarray((z * z).T)
    inside = np.arange(z.shape[1])[:, None] < size

    def loss(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        of = rows // len(GARCH_STARTS)
        omega, alpha, beta = _split(p)
        q, live = square[:, of], inside[:, of]
        s = q[0] + omega
        total = np.zeros(len(p))
        for t in range(len(q)):
            if t:
                s = omega + alpha * q[t - 1] + beta * s
            v = np.maximum(s, 1e-12)
            total += np.where(live[t], np.log(v) + q[t] / v, 0.0)
        return 0.5 * total

    logit = lambda q: math.log(q / (1 - q))
    starts = np.array([(math.log(o), logit(min(0.999, (a + b) / 0.9999)), logit(a / (a + b))) for o, a, b in GARCH_STARTS])
    points, values = simplex(loss, np.tile(starts, (len(fit), 1)))
    values = values.reshape(len(fit), -1)
    best = points.reshape(len(fit), len(GARCH_STARTS), 3)[np.arange(len(fit)), values.argmin(1)]
    omega, alpha, beta = _split(best)
    for k, (i, x, var) in enumerate(fit):
        o, a, b = float(omega[k]), float(alpha[k]), float(beta[k])
        s, path = o / max(1 - a - b, 1e-6), []
        for t in range(len(x)):
            if t:
                s = o + a * x[t - 1] * x[t - 1] + b * s
            path.append(math.sqrt(s * var))
        half = math.log(0.5) / math.log(a + b) if 0 < a + b < 1 else None
        out[i] = {"omega": o * var, "alpha": a, "beta": b, "persistence": a + b, "half_life": half, "converged": bool(np.isfinite(values[k].min())), "cond_vol": path}
    return out
