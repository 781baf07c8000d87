"""Spectra of frames and whole signals, and what is read off them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import KEY, ORD
from .framing import frame_arrays


def _by_length(rows: pd.Series, f) -> pd.Series:
    """f on stacked rows of equal length, in the order of rows."""
    out: list = [None] * len(rows)
    lengths = rows.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        values = f(np.stack([np.asarray(rows.iloc[i], float) for i in at])) if n else [np.zeros(0)] * len(at)
        for i, v in zip(at, values):
            out[i] = v
    return pd.Series(out)


def _arrays(f):
    """A function on stacked frames as a function on an array column."""

    @F.pandas_udf("array<double>")
    def run(ys: pd.Series) -> pd.Series:
        return _by_length(ys, f)

    return run


def magnitudes(ys: str) -> Column:
    """abs(rfft) / n of each frame, the Nyquist bin included."""
    return _arrays(lambda y: np.abs(np.fft.rfft(y, axis=1)) / y.shape[1])(ys)


def spectrum_half(ys: str) -> Column:
    """abs(fft) / n of bins 0 .. n // 2 - 1, without the Nyquist bin."""
    return _arrays(lambda y: np.abs(np.fft.fft(y, axis=1))[:, : y.shape[1] // 2] / y.shape[1])(ys)


def phases(ys: str) -> Column:
    return _arrays(lambda y: np.angle(np.fft.fft(y, axis=1))[:, : y.shape[1] // 2])(ys)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def spectra(samples: DataFrame, win: int, hop: int, sr: float = 1.0) -> DataFrame:
    """(signal_id, w, n, mag, freq): magnitude spectrum of each frame."""
    f = frame_arrays(samples, win, hop).withColumn("n", F.size("ys")).withColumn("mag", magnitudes("ys"))
    return f.withColumn("freq", F.transform("mag", lambda _, k: k * (sr / F.col("n")))).drop("ys")


def descriptors(spec: DataFrame) -> DataFrame:
    """Of each spectrum: centroid, entropy_bits, bandwidth, rolloff (85 %), flatness, entropy (natural, guarded)."""
    m, f = F.col("mag"), F.col("freq")
    df = spec.withColumn("_s", total(m)).withColumn("_p", F.transform("mag", lambda x: x / (F.col("_s") + 1e-10)))
    df = df.withColumn("_c", dot(f, F.col("_p")))
    bits = -total(F.transform(m, lambda x: F.when(x > 0, x / F.col("_s") * F.log2(x / F.col("_s"))).otherwise(0.0)))
    cum = F.aggregate(m, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["k"] + F.when(a["s"] + x < 0.85 * F.col("_s"), 1).otherwise(0)).alias("k")), lambda a: a["k"])
    df = df.withColumn("centroid", F.when(F.col("_s") > 0, F.try_divide(dot(f, m), F.col("_s"))).otherwise(0.0)).withColumn("entropy_bits", F.when(F.col("_s") > 0, bits).otherwise(0.0))
    df = df.withColumn("bandwidth", F.sqrt(total(F.zip_with(f, "_p", lambda a, p: (a - F.col("_c")) * (a - F.col("_c")) * p)))).withColumn("rolloff", F.try_element_at(f, F.least(cum, F.size(f) - 1) + 1))
    df = df.withColumn("flatness", F.exp(total(F.transform(m, lambda x: F.ln(x + 1e-10))) / F.size(m)) / (F.col("_s") / F.size(m) + 1e-10))
    df = df.withColumn("entropy", -total(F.transform("_p", lambda p: p * F.ln(p + 1e-10))))
    return df.drop("_s", "_p", "_c", "mag", "freq")


def whole(samples: DataFrame) -> DataFrame:
    """(signal_id, n, ys): each signal as one array."""
    return samples.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(ORD, "y"))), lambda s: s["y"]).alias("ys"), F.count("*").alias("n"))


def fft(samples: DataFrame, sr: float = 1.0, with_phase: bool = False) -> DataFrame:
    """(signal_id, bin, freq, mag[, phase]) of whole signals."""
    w = whole(samples).withColumn("mag", spectrum_half("ys"))
    cols = ["mag"]
    if with_phase:
        w, cols = w.withColumn("phase", phases("ys")), ["mag", "phase"]
    z = w.select(KEY, "n", F.posexplode(F.arrays_zip(*cols)).alias("bin", "z"))
    return z.select(KEY, F.col("bin").cast("bigint").alias("bin"), (F.col("bin") * (sr / F.col("n"))).alias("freq"), *(F.col(f"z.{c}").alias(c) for c in cols))


def dominant(samples: DataFrame, sr: float = 1.0) -> DataFrame:
    """(signal_id, freq, period, period_samples): the strongest bin but bin 0; whole samples are counted from the bin, free of rounding."""
    n = samples.groupBy(KEY).agg(F.count("*").alias("n"))
    top = fft(samples, sr).filter("bin > 0").groupBy(KEY).agg(F.max_by("bin", F.struct("mag", -F.col("bin"))).alias("bin")).join(n, KEY)
    freq = F.col("bin") * sr / F.col("n")
    return top.select(KEY, freq.alias("freq"), (1 / freq).alias("period"), F.floor(F.col("n") / F.col("bin")).alias("period_samples"))


def flatness_global(samples: DataFrame) -> DataFrame:
    """(signal_id, flatness) of the whole signal's spectrum; 1 where it is silent."""
    m = fft(samples).groupBy(KEY).agg(F.max("mag").alias("top"), F.avg("mag").alias("mean"), F.avg(F.ln(F.col("mag") + 1e-10)).alias("log"))
    return m.select(KEY, F.when(F.col("top") < 1e-10, 1.0).otherwise(F.exp("log") / (F.col("mean") + 1e-10)).alias("flatness"))


def chroma(spec: DataFrame, n_chroma: int = 12, ref: float = 27.5) -> DataFrame:
    """(signal_id, w, pitch, share): magnitude by pitch class counted from ref, as shares."""
    z = spec.select(KEY, "w", F.explode(F.arrays_zip("freq", "mag")).alias("z")).filter("z.freq > 0")
    pitch = F.pmod(F.rint(n_chroma * F.log2(F.col("z.freq") / ref)), F.lit(n_chroma)).cast("bigint")
    sums = z.groupBy(KEY, "w", pitch.alias("pitch")).agg(F.sum("z.mag").alias("m"))
    totals = sums.groupBy(KEY, "w").agg(F.sum("m").alias("t"))
    return sums.join(totals, [KEY, "w"]).select(KEY, "w", "pitch", F.when(F.col("t") > 0, F.try_divide("m", "t")).otherwise(0.0).alias("share"))


def mel_filterbank(n_mels: int, n_bins: int, sr: float) -> np.ndarray:
    """Triangular filters, equally spaced on 2595 log10(1 + f / 700); no area normalisation."""
    top = 2595 * math.log10(1 + sr / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    f = np.linspace(0, sr / 2, n_bins)
    up = (f[None] - hz[:-2, None]) / (hz[1:-1] - hz[:-2] + 1e-8)[:, None]
    down = (hz[2:, None] - f[None]) / (hz[2:] - hz[1:-1] + 1e-8)[:, None]
    return np.maximum(0, np.minimum(up, down))


def stft_array(y: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Magnitudes (bin, frame): periodic Hann, half a window of zeros on either side, whole frames, scaled by the window's sum."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    y = np.r_[np.zeros(n_fft // 2), y, np.zeros(n_fft // 2)]
    y = np.r_[y, np.zeros(-(len(y) - n_fft) % hop if len(y) >= n_fft else n_fft - len(y))]
    f = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop]
    return np.abs(np.fft.rfft(f * window, axis=1)).T / window.sum()


def _per_signal(samples: DataFrame, shape: str, f) -> DataFrame:
    """f(y) -> matrix (rows, columns) of each signal as rows (signal_id, frame, values)."""

    def run(batches):
        for b in batches:
            for key, ys in zip(b[KEY], b["ys"]):
                m = f(np.asarray(ys, float))
                yield pd.DataFrame({KEY: key, "frame": np.arange(m.shape[1]), "values": list(m.T)})

    return whole(samples).select(KEY, "ys").mapInPandas(run, shape)


FRAMES = f"{KEY} string, frame bigint, values array<double>"


def stft(samples: DataFrame, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    return _per_signal(samples, FRAMES, lambda y: stft_array(y, n_fft, hop))


def mel_array(y: np.ndarray, sr: float, n_mels: int, n_fft: int, hop: int) -> np.ndarray:
    mag = stft_array(y, n_fft, hop)
    m = mel_filterbank(n_mels, mag.shape[0], sr) @ mag
    return 20 * np.log10(m / (m.max() + 1e-8) + 1e-8)


def mel_spectrogram(samples: DataFrame, sr: float, n_mels: int = 128, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """(signal_id, frame, values): mel levels in dB under the signal's largest."""
    return _per_signal(samples, FRAMES, lambda y: mel_array(y, sr, n_mels, n_fft, hop))


def dct_matrix(n: int, k: int) -> np.ndarray:
    """The first k rows of the orthonormal DCT-II of n values."""
    m = np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n)[None] + 1) / (2 * n)) * math.sqrt(2 / n)
    m[0] /= math.sqrt(2)
    return m


def mfcc(samples: DataFrame, sr: float, n_mfcc: int = 20, n_mels: int = 128, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    return _per_signal(samples, FRAMES, lambda y: dct_matrix(n_mels, n_mfcc) @ mel_array(y, sr, n_mels, n_fft, hop))


def mel_levels(spec: DataFrame, n_mels: int, n_bins: int, sr: float) -> DataFrame:
    """(signal_id, w, mel, level): spectra of frames of one length through the filterbank, as a join with its non-zero weights."""
    spark = spec.sparkSession
    bank = mel_filterbank(n_mels, n_bins, sr)
    weights = [(int(m), int(k), float(bank[m, k])) for m, k in zip(*np.nonzero(bank))]
    table = spark.createDataFrame(weights, "mel bigint, bin int, weight double")
    z = spec.select(KEY, "w", F.posexplode("mag").alias("bin", "m"))
    return z.join(F.broadcast(table), "bin").groupBy(KEY, "w", "mel").agg(F.sum(F.col("weight") * F.col("m")).alias("level"))


def mel_bands(levels: DataFrame, n_mels: int) -> DataFrame:
    """(signal_id, w, band, level): mean of the low, mid and high third of the mel bands."""
    third = n_mels // 3
    band = F.when(F.col("mel") < third, "low").when(F.col("mel") < 2 * third, "mid").otherwise("high")
    return levels.groupBy(KEY, "w", band.alias("band")).agg(F.avg("level").alias("level"))
