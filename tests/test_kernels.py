"""Kernels against their definitions, and properties that must hold."""

import io
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavefold.functions import kernels as K
from wavefold.operators.forecast import correlations, forecast_many
from wavefold.operators.similarity import describe_window, jensen_shannon
from wavefold.operators.spectral import dct_matrix, mel_filterbank, stft_array
from wavefold.schemas import feature_names
from wavefold.sources.wav import decode, resample

series = st.lists(st.integers(-5, 5), min_size=0, max_size=40).map(lambda v: np.array(v, float))


def plain_peaks(x):
    out = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            out.append((i + j) // 2)
    return out


@given(series)
def test_peaks(x):
    assert K.find_peaks(x).tolist() == plain_peaks(x)
    far = K.find_peaks(x, distance=4)
    assert (np.diff(far) >= 4).all() and set(far) <= set(plain_peaks(x))
    assert all(K.prominence_of(x, p) >= 2 for p in K.find_peaks(x, prominence=2))
    assert all(x[p] >= 1 for p in K.find_peaks(x, height=1))


def test_peaks_degenerate():
    for n in (0, 1, 2, 5, 9):
        assert len(K.find_peaks(np.ones(n))) == len(K.find_peaks(np.arange(n))) == 0


@given(series, st.integers(1, 9))
def test_mirror_mean(x, size):
    if len(x) >= size:
        out = K.mirror_mean(x, size)
        assert len(out) == len(x) and np.allclose(K.mirror_mean(np.ones(len(x)), size), 1)
        mid = len(x) // 2
        lo = mid - size // 2
        if lo >= 0 and lo + size <= len(x):
            assert np.isclose(out[mid], x[lo : lo + size].mean())


@given(st.lists(st.floats(-10, 10), min_size=2, max_size=30), st.integers(2, 60))
def test_stretch(x, m):
    out = K.stretch(x, m)
    assert len(out) == m and np.isclose(out[0], x[0]) and np.isclose(out[-1], x[-1])
    assert np.allclose(K.stretch(x, len(x)), x)


def ar1(n, phi, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + rng.standard_normal()
    return x


def test_partial_correlations_of_ar1_cut_off():
    r = K.durbin_levinson(correlations(ar1(800, 0.7, 2)[100:], 10))
    assert r[1] > 0.6 and np.abs(r[2:]).max() < 0.12
    assert K.durbin_levinson(np.zeros(0)).tolist() == [] and K.durbin_levinson(np.array([1.0, 1.0, 1.0])).tolist() == [1.0, 1.0, 0.0]


def test_garch():
    rng = np.random.default_rng(1)
    s, r = 1.0, np.zeros(1500)
    for t in range(1500):
        if t:
            s = 0.05 + 0.1 * r[t - 1] ** 2 + 0.85 * s
        r[t] = rng.standard_normal() * np.sqrt(s)
    f = K.garch_fit(r)
    assert 0 <= f["persistence"] < 1 and 0.85 < f["persistence"] and f["converged"] and len(f["cond_vol"]) == 1500
    big = K.garch_fit(10 * r)
    assert np.isclose(big["omega"], 100 * f["omega"], rtol=0.02) and np.isclose(big["alpha"], f["alpha"], atol=0.01)
    assert not K.garch_fit(r[:5])["converged"] and not K.garch_fit(np.ones(50))["converged"]


def test_unit_root():
    rng = np.random.default_rng(0)
    assert not K.adf(np.cumsum(rng.standard_normal(300)))[1] and K.adf(ar1(300, 0.5, 1))[1]


def test_arma():
    f = K.arma_fit(ar1(500, 0.6, 3), 1, 0, 0)
    assert abs(f["ar"][0] - 0.6) < 0.1 and len(K.arma_forecast(f, 7)) == 7
    x = np.arange(60.0)
    assert np.allclose(K.arma_forecast(K.arma_fit(x, 0, 2, 0), 3), [60, 61, 62])


def test_hmm():
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 0.3, 60), rng.normal(5, 0.3, 60), rng.normal(0, 0.3, 60)]
    m = K.hmm_fit(x, 2, 1)
    assert (np.diff(m["trace"]) > -1e-6).all() and np.allclose(m["trans"].sum(1), 1)
    assert (np.diff(m["states"]) != 0).sum() == 2


def test_nmf():
    rng = np.random.default_rng(5)
    x = rng.random((12, 3)) @ rng.random((3, 20))
    w, h, trace = K.nmf(x, 3)
    assert (w >= 0).all() and (h >= 0).all() and (np.diff(trace) <= 1e-9).all() and np.mean((x - w @ h) ** 2) < 0.01 * np.mean(x**2)


def test_ridge_and_forecasts():
    t = np.arange(120)
    x = np.sin(2 * np.pi * t / 12)
    assert np.abs(K.ridge_ar(x[:110], 24, 10, 1e-3) - x[110:]).max() < 0.1
    assert np.allclose(K.ridge_ar(np.ones(40), 5, 3), 1)
    assert all(r[5] == "too short" for r in forecast_many([np.ones(8)], 10)[0])
    assert {r[0] for r in forecast_many([x], 10, ("naive", "arima", "hmm"))[0]} == {"naive", "arima", "hmm"}
    with pytest.raises(ValueError):
        forecast_many([x], 10, ("oracle",))


def test_spectral():
    y = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    m = stft_array(y, 2048, 512)
    assert m.shape[0] == 1025 and abs(m[:, 10].argmax() * 16000 / 2048 - 440) < 8
    d = dct_matrix(16, 16)
    assert np.allclose(d @ d.T, np.eye(16))
    assert (mel_filterbank(20, 1025, 16000) >= 0).all()
    f = dict(zip(feature_names(), describe_window(y[:8000], 16000, 0.5)))
    assert len(f) == 61 and abs(f["spectral_centroid"] - 440) < 1 and abs(f["rms_energy"] - 0.7071) < 1e-3


@settings(deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=30))
def test_divergence_of_equal_samples_is_zero(x):
    assert abs(jensen_shannon(np.array(x), np.array(x))) < 1e-9


def test_wav():
    x = (np.sin(np.arange(4000) / 20) * 30000).astype("<i2")
    data = io.BytesIO()
    with wave.open(data, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.repeat(x, 2).tobytes())
    y, sr = decode(data.getvalue())
    assert sr == 8000 and np.allclose(y, x / 32768)
    assert len(resample(y, 8000, 16000)) == 8000 and np.allclose(resample(y, 8000, 16000)[::2][100:-100], y[100:-100], atol=0.02)
