"""Similarity of feature rows: matrices, matches, distributions, patterns."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import best_of, crossed, dots, pieces
from ..functions.kernels import durbin_levinson, find_peaks
from ..functions.series import KEY, histogram_distance
from ..schemas import WINDOW_SCALARS, WINDOW_VECTORS
from .framing import frame_arrays
from .spectral import dct_matrix, dot


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def likeness(c: np.ndarray) -> np.ndarray:
    """exp(-3 (1 - c)**2) of cosines c, in their place."""
    np.subtract(1, c, out=c)
    np.multiply(c, c, out=c)
    np.multiply(c, -3, out=c)
    return np.exp(c, out=c)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt(dots(x, x)) + 1e-12)[:, None]


def _matrix(ids: tuple, aw: np.ndarray, a: np.ndarray, bw: np.ndarray, b: np.ndarray, digits: int | None) -> Iterator[pa.RecordBatch]:
    """likeness() of all rows of a with all of b, by pieces, a row of a with arrays of the rows of b, rounded to digits; null where a vector is (their rows are nan)."""
    for part in pieces(len(a), len(b)):
        s = likeness(a[part] @ b.T)
        if digits is not None:
            s *= 10.0**digits
            s += 0.5
            np.floor(s, out=s)
            s /= 10.0**digits
        n, ends = len(s), pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(b))
        columns = [*(pa.repeat(pa.scalar(k), n) for k in ids), pa.array(aw[part]), pa.ListArray.from_arrays(ends, pa.array(np.tile(bw, n))), pa.ListArray.from_arrays(ends, pa.array(s.ravel(), from_pandas=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["a_id", "b_id", "a_w", "bs", "sims"])


MATRIX = "a_id string, b_id string, a_w bigint, b_w bigint, sim double"
ARRAYS = "a_id string, b_id string, a_w bigint, bs array<bigint>, sims array<double>"


def _listed(arrays: DataFrame) -> DataFrame:
    """A row for each pair of the arrays of _matrix(): the JVM makes them for less than they cost to be handed over."""
    return arrays.select("a_id", "b_id", "a_w", "bs", F.posexplode("sims").alias("_p", "sim")).select("a_id", "b_id", "a_w", F.col("bs")[F.col("_p")].alias("b_w"), "sim")


def similarity_matrix(rows: DataFrame, pair: DataFrame, vector: str = "x", digits: int | None = None) -> DataFrame:
    """(a_id, b_id, a_w, b_w, sim): exp(-3 (1 - cosine)**2) of every window of a with every window of b of a pair."""

    def run(ids: tuple, aw: np.ndarray, a: np.ndarray, bw: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        return _matrix(ids, aw, unit(a), bw, unit(b), digits)

    return _listed(crossed(rows, pair, run, ARRAYS, vector=vector))


def whitened(rows: DataFrame, pair: DataFrame, keep: float = 0.95, vector: str = "x", digits: int | None = None) -> DataFrame:
    """(a_id, b_id, a_w, b_w, sim) after joint standardising and PCA whitening of each pair, with the components that hold ``keep`` of the variance, at least 3.

    A signal's moments are summed by batches, and a pair's come from those of its two signals.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for key, part in df.groupby(KEY):
                n, m, q = moments(np.stack(part[vector].to_numpy()).astype(float))
                yield pd.DataFrame({KEY: [key], "n": [n], "m": [m], "q": [q.ravel()]})

    def basis(ids: tuple, df: pd.DataFrame) -> pd.DataFrame:
        a, b = (functools.reduce(merged, [(n, np.asarray(m), np.asarray(q).reshape(len(m), -1)) for n, m, q in zip(s.n, s.m, s.q)], None) for s in (df[df.side == "a"], df[df.side == "b"]))
        note = [] if a is None or b is None else [np.concatenate([v.ravel() for v in whitening(a, b, keep)])]
        return pd.DataFrame({"a_id": [ids[0]], "b_id": [ids[1]], "note": note}) if note else pd.DataFrame(columns=["a_id", "b_id", "note"])

    sums = rows.select(KEY, vector).mapInPandas(partial, f"{KEY} string, n bigint, m array<double>, q array<double>")
    sides = [pair.join(sums.withColumnRenamed(KEY, f"{s}_id"), f"{s}_id").select("a_id", "b_id", F.lit(s).alias("side"), "n", "m", "q") for s in ("a", "b")]
    notes = sides[0].union(sides[1]).groupBy("a_id", "b_id").applyInPandas(basis, "a_id string, b_id string, note array<double>")

    def run(ids: tuple, aw: np.ndarray, a: np.ndarray, bw: np.ndarray, b: np.ndarray, note: np.ndarray) -> Iterator[pa.RecordBatch]:
        mean, turn = note[: a.shape[1]], note[a.shape[1] :].reshape(a.shape[1], -1)
        return _matrix(ids, aw, unit((a - mean) @ turn), bw, unit((b - mean) @ turn), digits)

    return _listed(crossed(rows, pair, run, ARRAYS, vector=vector, notes=notes))


def moments(x: np.ndarray) -> tuple:
    """Number, mean and summed products of the deviations of rows."""
    m = x.mean(0)
    return len(x), m, (x - m).T @ (x - m)


def merged(a: tuple | None, b: tuple) -> tuple:
    """moments() of two sets of rows together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whitening(a: tuple, b: tuple, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the matrix that standardises and whitens deviations from it, of two sets with these moments; sets of 5 and less are only standardised."""
    n, mean, q = merged(a, b)
    sd = np.sqrt(np.diag(q) / n)
    scale = 1 / np.where(sd < 1e-10, 1, sd)
    if min(a[0], b[0]) <= 5:
        return mean, np.diag(scale)
    value, basis = np.linalg.eigh(q * np.outer(scale, scale) / (n - 1))
    value, basis = value[::-1], basis[:, ::-1]
    k = min(max(3, int(np.searchsorted(np.cumsum(value) / value.sum(), keep)) + 1), len(value))
    return mean, scale[:, None] * basis[:, :k] / np.sqrt(np.maximum(value[:k], 1e-10))


def nearest(rows: DataFrame, pair: DataFrame, back: bool = False, vector: str = "x") -> DataFrame:
    """(a_id, b_id, a_w, b_w, sim): the b most similar to every a, the first of equals; with ``back`` also the a most similar to every b, the ids and places being swapped.

    The matrix of similarities is only held by pieces.
    """

    def run(ids: tuple, aw: np.ndarray, a: np.ndarray, bw: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = unit(a), unit(b)
        for key, sides in ((ids, (aw, a, bw, b)), *([(ids[::-1], (bw, b, aw, a))] if back else [])):
            for w, s, other in best_of(*sides, likeness):
                yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(k), len(w)) for k in key), pa.array(w), pa.array(other), pa.array(s)], names=["a_id", "b_id", "a_w", "b_w", "sim"])

    return best_matches(crossed(rows, pair, run, MATRIX, vector=vector), None)


def best_matches(sim: DataFrame, over: float | None = 0.7) -> DataFrame:
    """(a_id, b_id, a_w, b_w, sim): the best b of every a, the first of equals; kept over a limit."""
    best = sim.groupBy("a_id", "b_id", "a_w").agg(F.max(F.struct("sim", (-F.col("b_w")).alias("m"))).alias("z"))
    out = best.select("a_id", "b_id", "a_w", (-F.col("z.m")).alias("b_w"), F.col("z.sim").alias("sim"))
    return out if over is None else out.filter(F.col("sim") > over)


def aggregate(best: DataFrame, pair: DataFrame, entropy: DataFrame, distance: DataFrame) -> DataFrame:
    """(a_id, b_id, simple, weighted, distribution, similarity): .60, .25 and .15 of them, in percent.

    best: nearest() with ``back``; entropy: (signal_id, w, spectral_entropy), the
    weights of windows; distance: (a_id, b_id, distance), null counting as neutral.
    """
    key = ["a_id", "b_id"]
    e = entropy.select(F.col(KEY).alias("a_id"), F.col("w").alias("a_w"), F.col("spectral_entropy").alias("e"))
    means = best.join(e, ["a_id", "a_w"]).groupBy(*key).agg(F.avg("sim").alias("m"), (F.sum(F.col("e") * F.col("sim")) / (F.sum("e") + 1e-12)).alias("w"))
    there = means.select(*key, F.col("m").alias("ma"), F.col("w").alias("wa"))
    back = means.select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id"), F.col("m").alias("mb"), F.col("w").alias("wb"))
    z = pair.join(there, key).join(back, key).join(distance, key, "left")
    z = z.select(*key, ((F.col("ma") + F.col("mb")) / 2).alias("simple"), ((F.col("wa") + F.col("wb")) / 2).alias("weighted"), F.coalesce(F.exp(-3 * F.col("distance")), F.lit(0.5)).alias("distribution"))
    whole = 0.60 * F.col("simple") + 0.25 * F.col("weighted") + 0.15 * F.col("distribution")
    return z.withColumn("similarity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), whole)) * 100)


def distribution_distance(rows: DataFrame, pair: DataFrame, method: str = "wasserstein", vector: str = "x") -> DataFrame:
    """(a_id, b_id, dim, distance) for each place of the vectors.

    wasserstein: histograms over a's range; difference: |gap of means| over the
    summed deviations; js: Jensen-Shannon divergence of Gaussian kernel
    densities on 200 points. Where neither side varies it is 0.
    """
    key = ["a_id", "b_id", "dim"]
    long = rows.select(KEY, F.posexplode(vector).alias("dim", "v")).withColumn("dim", F.col("dim").cast("bigint"))
    a = pair.join(long.withColumnRenamed(KEY, "a_id"), "a_id").select(*key, "v")
    b = pair.join(long.withColumnRenamed(KEY, "b_id"), "b_id").select(*key, "v")
    sa, sb = (d.groupBy(*key).agg(F.avg("v").alias(f"m{s}"), F.stddev_pop("v").alias(f"d{s}"), F.count("*").alias(f"n{s}")) for s, d in (("a", a), ("b", b)))
    both = sa.join(sb, key)
    flat = (F.col("da") < 1e-12) & (F.col("db") < 1e-12)
    if method == "wasserstein":
        bins = F.greatest(F.lit(10), F.least(F.lit(50), F.floor(F.sqrt(F.least("na", "nb")))))
        sized = both.select(*key, bins.alias("bins"))
        emd = histogram_distance(a.join(sized, key), b.join(sized, key), key, "v", F.col("bins"))
        return both.join(emd, key, "left").select(*key, F.when(flat, 0.0).otherwise(F.col("emd")).alias("distance"))
    if method == "js":

        def run(df: pd.DataFrame) -> pd.DataFrame:
            x, y = (df[df.side == s].v.to_numpy(float) for s in ("a", "b"))
            d = 0.0 if x.std() < 1e-12 and y.std() < 1e-12 else jensen_shannon(x, y)
            return pd.DataFrame([[df.a_id.iloc[0], df.b_id.iloc[0], df.dim.iloc[0], d]], columns=[*key, "distance"])

        return a.withColumn("side", F.lit("a")).union(b.withColumn("side", F.lit("b"))).groupBy(*key).applyInPandas(run, "a_id string, b_id string, dim bigint, distance double")
    return both.select(*key, F.when(flat, 0.0).otherwise(F.abs(F.col("ma") - F.col("mb")) / (F.col("da") + F.col("db") + 1e-10)).alias("distance"))


def jensen_shannon(x: np.ndarray, y: np.ndarray, points: int = 200) -> float:
    grid = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), points)

    def density(v: np.ndarray) -> np.ndarray:
        h = max(v.std(ddof=1) if len(v) > 1 else 0.0, 1e-9) * len(v) ** -0.2
        p = np.exp(-0.5 * ((grid[:, None] - v[None]) / h) ** 2).sum(1) + 1e-12
        return p / p.sum()

    p, q = density(x), density(y)
    m = (p + q) / 2
    return float(0.5 * np.sum(p * np.log(p / m)) + 0.5 * np.sum(q * np.log(q / m)))


def median_distance(distances: DataFrame) -> DataFrame:
    return distances.groupBy("a_id", "b_id").agg(F.coalesce(F.median("distance"), F.lit(0.0)).alias("distance"))


def self_similarity(rows: DataFrame, max_lag: int, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, lag, w, sim): cosine of each row with the one lag rows later, by an equi-join on the ordinal."""
    late = rows.select(KEY, F.col(order).alias("_w"), F.col(vector).alias("_b"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")).withColumn(order, F.col("_w") - F.col("lag"))
    return late.join(rows.select(KEY, order, vector), [KEY, order]).select(KEY, F.col("lag").cast("bigint").alias("lag"), order, cosine(F.col(vector), F.col("_b")).alias("sim"))


def repetition_peaks(sim: DataFrame, height: float = 0.85, distance: int = 3, top: int = 50) -> DataFrame:
    """(signal_id, lag, p, sim): peaks along each lag, the first ``top`` in order of lag and place."""
    from .trends import peaks

    found = peaks(sim, [KEY, "lag"], "w", "sim", height=height, distance=distance)
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy("lag", "p"))).filter(F.col("_r") <= top).drop("_r")


def novelty(rows: DataFrame, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, w, novelty): a checkerboard drawn along the diagonal of the self-similarity, before against after, scaled to 1."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order)
        x = np.stack(df[vector].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        n = len(x)
        k = max(3, n // 20)
        board = np.outer(*[np.where(np.arange(k) < k / 2, 1.0, -1.0)] * 2)
        out = np.zeros(n)
        for i in range(k, n - k):
            out[i] = max(0.0, float((x[i - k : i] @ x[i : i + k].T * board).sum()))
        return pd.DataFrame({KEY: df[KEY], order: df[order], "novelty": out / (out.max() + 1e-12) if n else out})

    return rows.select(KEY, order, vector).groupBy(KEY).applyInPandas(run, f"{KEY} string, {order} bigint, novelty double")


def boundaries(curve: DataFrame, height: float = 0.3, order: str = "w") -> DataFrame:
    """(signal_id, p, novelty): peaks of a novelty curve, a twentieth of the signal apart, and 3 at least."""
    from .trends import peaks

    def wide(n: int) -> int:
        return max(3, n // 20)

    return peaks(curve, [KEY], order, "novelty", height=height, distance_of=wide)


def patterns(features: DataFrame, rows: DataFrame, cap: int = 200) -> DataFrame:
    """(signal_id, kind, w, lag, value): climaxes, repetitions at lags from 2 on (on about cap rows of a signal) and boundaries; none under 3 rows.

    features has the window scalars, rows (signal_id, w, x) the vectors, w
    counting from 0. Places found on thinned rows are those of the whole signal.
    """
    n = rows.groupBy(KEY).agg(F.count("*").alias("_n"))
    rows = rows.join(n, KEY).filter("_n >= 3")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / cap))
    thin = rows.filter(F.col("w") % step == 0).select(KEY, (F.col("w") / step).cast("bigint").alias("w"), "x", step.alias("_s"))
    again = repetition_peaks(self_similarity(thin, 2 * cap).filter("lag >= 2")).join(thin.select(KEY, "_s").distinct(), KEY)
    parts = [
        climaxes(features).select(KEY, F.lit("climax").alias("kind"), "w", F.lit(None).cast("bigint").alias("lag"), F.col("rms_energy").alias("value")),
        again.select(KEY, F.lit("repetition").alias("kind"), (F.col("p") * F.col("_s")).alias("w"), (F.col("lag") * F.col("_s")).alias("lag"), F.col("sim").alias("value")),
        boundaries(novelty(rows.select(KEY, "w", "x"))).select(KEY, F.lit("boundary").alias("kind"), F.col("p").alias("w"), F.lit(None).cast("bigint").alias("lag"), F.col("novelty").alias("value")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def analyze(features: DataFrame, rows: DataFrame, pair: DataFrame) -> dict[str, DataFrame]:
    """The whole comparison of pairs: matrix, scores, best matches both ways with their features, and each signal's patterns."""
    best = nearest(rows, pair, back=True).persist()
    distance = median_distance(distribution_distance(rows, pair, "difference"))
    scores = aggregate(best, pair, features.select(KEY, "w", "spectral_entropy"), distance)
    return {"matrix": similarity_matrix(rows, pair), "scores": scores, "matches": annotate(best.filter("sim > 0.7"), features), "patterns": patterns(features, rows)}


def climaxes(features: DataFrame, energy: float = 0.85, onset: float = 0.80) -> DataFrame:
    """Windows whose energy and onset density both reach their percentile."""
    p = features.groupBy(KEY).agg(F.percentile("rms_energy", F.lit(energy)).alias("_e"), F.percentile("onset_density", F.lit(onset)).alias("_o"))
    return features.join(p, KEY).filter((F.col("rms_energy") >= F.col("_e")) & (F.col("onset_density") >= F.col("_o"))).drop("_e", "_o")


def _resampled(x: np.ndarray, m: int) -> np.ndarray:
    """x resampled to m points through its spectrum."""
    n = len(x)
    if m == n:
        return x
    spec = np.fft.rfft(x)
    out = np.zeros(m // 2 + 1, complex)
    k = min(m, n)
    out[: k // 2 + 1] = spec[: k // 2 + 1]
    if k % 2 == 0:
        out[k // 2] *= 2 if m < n else 0.5
    return np.fft.irfft(out, m) * (m / n)


def describe_window(y: np.ndarray, sr: float, seconds: float) -> list[float]:
    """The 61 features of one window, in the order of schemas.feature_names()."""
    n = len(y)
    square = y * y
    flux = np.abs(np.diff(square))
    env = _resampled(np.abs(y), min(256, n))
    env = env - env.mean()
    r = np.correlate(env, env, "full")[len(env) - 1 :]
    r = r / (r[0] + 1e-10)
    lo, hi = max(1, int(0.3 * len(env) / seconds)), min(len(r), int(1.0 * len(env) / seconds))
    rms = math.sqrt(square.mean())
    mag, freq = np.abs(np.fft.rfft(y)) / n, np.fft.rfftfreq(n, 1 / sr)
    p = mag / (mag.sum() + 1e-10)
    centroid = float(freq @ p)
    cum = np.cumsum(mag)
    rolloff = float(freq[min(int(np.searchsorted(cum, 0.85 * cum[-1])), len(freq) - 1)])
    scalars = [
        float((flux > flux.mean() + flux.std()).sum() / n), flux.mean(), flux.std(), float(r[lo:hi].max()) if lo < hi else 0.0, rms, float(-(square * np.log(square + 1e-10)).sum() / n),
        float(np.abs(np.diff(np.signbit(y).astype(int))).sum() / (2 * n)), float(np.abs(y).max() / (rms + 1e-10)), centroid, float(math.sqrt(((freq - centroid) ** 2) @ p)), rolloff,
        float(np.exp(np.log(mag + 1e-10).mean()) / (mag.mean() + 1e-10)), float(-(p * np.log(p + 1e-10)).sum()),
    ]
    chroma = np.zeros(12)
    np.add.at(chroma, np.mod(np.rint(12 * np.log2(freq[1:] / 27.5)).astype(int), 12), mag[1:])
    chroma = chroma / chroma.sum() if chroma.sum() > 0 else chroma
    c = y - y.mean()
    zero = float(c @ c)
    acf = np.array([float(c[: n - k] @ c[k:]) / zero if zero else 1.0 for k in range(6)])
    edges = np.geomspace(max(freq[1], 1e-6), freq[-1], 14)
    level = np.array([mag[(freq >= a) & (freq < b)].mean() if ((freq >= a) & (freq < b)).any() else 0.0 for a, b in zip(edges[:-1], edges[1:])])
    mfcc = dct_matrix(13, 13) @ np.log(level + 1e-10)
    return [*map(float, scalars), *acf[1:], *durbin_levinson(acf)[1:], *chroma, *mfcc, *np.zeros(13)]


def window_features(samples: DataFrame, win: int, hop: int, sr: float = 1.0, least: int = 64) -> DataFrame:
    """(signal_id, w, the 13 scalars, acf, pacf, chroma, mfcc_mean, mfcc_std, x): windows under ``least`` samples are left out."""

    @F.pandas_udf("array<double>")
    def described(ys: pd.Series) -> pd.Series:
        return ys.map(lambda y: describe_window(np.asarray(y, float), sr, win / sr))

    df = frame_arrays(samples, win, hop).filter(F.size("ys") >= least).select(KEY, "w", described("ys").alias("x"))
    cols, at = [F.col("x")[k].alias(name) for k, name in enumerate(WINDOW_SCALARS)], len(WINDOW_SCALARS)
    for name, size in WINDOW_VECTORS.items():
        cols.append(F.slice("x", at + 1, size).alias(name))
        at += size
    return df.select(KEY, "w", *cols, "x")


PITCHES = ("A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#")


def annotate(matches: DataFrame, features: DataFrame, top: int = 10) -> DataFrame:
    """The best matches of a pair with labels of rhythm, energy, timbre and pitch of a's window."""
    place = F.row_number().over(Window.partitionBy("a_id", "b_id").orderBy(F.col("sim").desc(), "a_w"))
    f = features.select(F.col(KEY).alias("a_id"), F.col("w").alias("a_w"), "onset_density", "rms_energy", "spectral_flatness", "spectral_centroid", "chroma")
    z = matches.withColumn("rank", place).filter(F.col("rank") <= top).join(f, ["a_id", "a_w"])
    rhythm = F.when(F.col("onset_density") > 0.3, "dense").when(F.col("onset_density") > 0.15, "medium").otherwise("sparse")
    energy = F.when(F.col("rms_energy") > 0.5, "high").when(F.col("rms_energy") > 0.15, "medium").otherwise("low")
    timbre = F.when(F.col("spectral_flatness") > 0.5, "noisy").when(F.col("spectral_centroid") > 2000, "bright").when(F.col("spectral_centroid") > 800, "balanced").otherwise("dark")
    pitch = F.element_at(F.array(*map(F.lit, PITCHES)), F.array_position("chroma", F.array_max("chroma")).cast("int"))
    return z.select("a_id", "b_id", "rank", "a_w", "b_w", "sim", rhythm.alias("rhythm"), energy.alias("energy"), timbre.alias("timbre"), pitch.alias("pitch"))
