"""Batched fits against plain recursions, and the kernels that reports rest on."""

import math

import numpy as np
import pytest

from wavefold.functions import fits
from wavefold.functions.kernels import find_peaks, garch_variance
from wavefold.operators.discovery import matched_stretches
from wavefold.operators.forecast import ORDERS, forecast_many
from wavefold.operators.unsupervised import recurrence_lines


def arma(n, ar, ma, seed):
    rng = np.random.default_rng(seed)
    e, x = rng.standard_normal(n + 100), np.zeros(n + 100)
    for t in range(4, n + 100):
        x[t] = sum(a * x[t - 1 - j] for j, a in enumerate(ar)) + e[t] + sum(b * e[t - 1 - j] for j, b in enumerate(ma))
    return x[100:]


def plain_residuals(z, ar, ma):
    e = np.zeros(len(z))
    for t in range(len(z)):
        e[t] = z[t] - sum(a * z[t - 1 - j] for j, a in enumerate(ar) if t > j) - sum(b * e[t - 1 - j] for j, b in enumerate(ma) if t > j)
    return e


def test_arma_batches_agree_with_plain_recursion():
    series = [arma(n, [0.5, -0.2], [0.4], n) * 7 + 3 for n in (40, 61, 25, 300)] + [np.arange(30.0), np.ones(20), np.array([1.0, 2.0, 1.0])]
    every = fits.arma_fits(series, [0] * len(series), ORDERS)
    for x, own in zip(series, every):
        assert [f["order"] for f in own] == [(p, 0, q) for p, q in ORDERS]
        for f in own:
            e = plain_residuals(x - x.mean(), f["ar"], f["ma"])
            assert np.allclose(e, f["resid"], atol=1e-6 * (1 + np.abs(x).max()))
            s2 = max(np.mean(e * e), 1e-300)
            assert f["aic"] == pytest.approx(len(x) * (math.log(2 * math.pi * s2) + 1) + 2 * (sum(f["order"]) + 2), abs=1e-3) or s2 < 1e-20
    big = fits.arma_fits([arma(4000, [0.6], [0.4], 1)], [0], ((1, 1), (0, 0)))[0]
    assert abs(big[0]["ar"][0] - 0.6) < 0.06 and abs(big[0]["ma"][0] - 0.4) < 0.06 and big[0]["aic"] < big[1]["aic"]


def test_a_fit_does_not_depend_on_its_batch():
    a, b = arma(50, [0.7], [], 3), arma(90, [0.1], [0.6], 4)
    for alone, both in zip(fits.arma_fits([a], [0], ORDERS)[0], fits.arma_fits([a, b], [0, 0], ORDERS)[0]):
        assert np.allclose(alone["resid"], both["resid"], atol=1e-5)
    assert [r[:3] for r in forecast_many([a], 5, ("arima",))[0]] == [("arima", k, pytest.approx(r[2])) for k, r in enumerate(forecast_many([b, a], 5, ("arima",))[1])]


def test_garch_batches():
    rng = np.random.default_rng(0)
    r, s = np.zeros(2500), 1.0
    for t in range(2500):
        s = 0.05 + 0.1 * (r[t - 1] ** 2 if t else 1) + 0.85 * s
        r[t] = math.sqrt(s) * rng.standard_normal()
    one, short, flat, again = fits.garch_fits([r, r[:5], np.ones(40), r[:400]])
    assert 0.85 < one["persistence"] < 0.99 and one["converged"] and not short["converged"] and not flat["converged"] and again["converged"]
    assert one["omega"] == pytest.approx(fits.garch_fits([r])[0]["omega"])
    z = r - r.mean()
    path = garch_variance(z, one["omega"], one["alpha"], one["beta"], one["omega"] / (1 - one["persistence"]))
    assert np.allclose(np.sqrt(path), one["cond_vol"], rtol=1e-6)


def test_series_batches_join_series_over_frames():
    import pandas as pd

    df = pd.DataFrame({"k": list("aaabbbbc"), "v": np.arange(8.0)})
    got = [x for size in (2, 100) for keys, values in fits.series_batches(iter([df[:2], df[2:5], df[5:5], df[5:]]), ["k"], "v", size) for x in zip(keys, map(list, values))]
    assert got == [(("a",), [0, 1, 2]), (("b",), [3, 4, 5, 6]), (("c",), [7])] * 2


def test_corresponding_stretches():
    bump = np.concatenate([np.zeros(20), np.hanning(9), np.zeros(31)])
    late = np.roll(bump, 17)
    found = matched_stretches(bump, late)
    assert len(found) == 1 and found[0][1] - found[0][0] == 17 and found[0][6] == "strong" and found[0][3] > 0.99
    # The last start that is looked at is the one before the end: a rise at the very end isn't found.
    x = np.zeros(60)
    x[28:33] = [1, 2, 3, 2, 1]
    y = np.zeros(60)
    y[-6:] = x[27:33]
    assert all(start + width < 60 for _, start, width, *_ in matched_stretches(x, y))
    # A match of .55 or less does not count, whatever the correlation.
    rng = np.random.default_rng(2)
    assert all(f[3] > 0.55 for s in range(20) for f in matched_stretches(rng.standard_normal(50), rng.standard_normal(50)))
    assert matched_stretches(x[:7], y) == []


def plain_lines(x, threshold):
    n = len(x)
    d = [[math.dist(a, b) for b in x] for a in x]
    far = max(max(r) for r in d)
    near = [[i != j and d[i][j] < threshold * far for j in range(n)] for i in range(n)]

    def runs(line):
        out, k = [], 0
        for v in [*line, False]:
            if v:
                k += 1
            else:
                out.append(k)
                k = 0
        return [k for k in out if k >= 2]

    diagonal = [k for s in range(-n + 1, n) for k in runs([near[i][i + s] for i in range(n) if 0 <= i + s < n])]
    vertical = [k for j in range(n) for k in runs([near[i][j] for i in range(n)])]
    total = sum(map(sum, near))
    p = [diagonal.count(k) / (len(diagonal) + 1e-12) for k in set(diagonal)]
    mean = lambda v: sum(v) / len(v) if v else 1.0
    return total / n**2, sum(diagonal) / max(total, 1), sum(vertical) / max(total, 1), mean(diagonal), mean(vertical), -sum(q * math.log(q + 1e-12) for q in p)


@pytest.mark.parametrize("seed", range(4))
def test_recurrence_lines(seed):
    rng = np.random.default_rng(seed)
    x = np.sin(np.arange(30) / (1 + seed))[:, None] + 0.1 * rng.standard_normal((30, 2))
    assert recurrence_lines(x, 0.2) == pytest.approx(plain_lines(x, 0.2))
    assert recurrence_lines(np.ones((5, 2)), 0.2) == (0.0, 0.0, 0.0, 1.0, 1.0, 0.0)


def test_peaks_on_plateaus():
    assert find_peaks([0, 1, 1, 0, 2, 0]).tolist() == [1, 4]
